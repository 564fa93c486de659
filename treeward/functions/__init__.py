"""treeward.functions"""
