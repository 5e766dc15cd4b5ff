"""Evidence-backed property graph analytics on PySpark DataFrames."""
