"""Marketing analytics on PySpark DataFrames."""
