"""treeward.streaming"""
