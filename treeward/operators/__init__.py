"""treeward.operators"""
