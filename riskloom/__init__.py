"""Transaction-risk analytics written on the PySpark DataFrame, SQL and ML APIs."""
