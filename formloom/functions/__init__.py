"""Column-level functions: every one takes and returns Spark ``Column``s."""
