"""echofold: retrieval-based time-series forecasting on Spark DataFrames."""
