"""Network-flow classification and monitoring on PySpark DataFrames."""
