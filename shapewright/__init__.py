"""Graph-shape validation and analytics on PySpark DataFrames."""
