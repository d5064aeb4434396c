"""A time-series analytics engine and training-data operators on Spark DataFrames."""
