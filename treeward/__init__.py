"""treeward: filesystem-catalog analytics as plain Spark DataFrame jobs."""
