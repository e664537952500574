"""Contract-graph analytics on PySpark: DataFrames in, DataFrames out."""
