"""Order-aware columnar analytics on PySpark DataFrames."""
