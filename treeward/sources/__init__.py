"""treeward.sources"""
