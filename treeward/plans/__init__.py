"""treeward.plans"""
