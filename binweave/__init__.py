"""Multi-dimensional generalised binned tables on PySpark DataFrames."""
