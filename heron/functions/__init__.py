"""Column functions: they stay inside Spark's generated code."""
