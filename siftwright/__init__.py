"""Data-quality audit and label-signal operators on Spark DataFrames."""
