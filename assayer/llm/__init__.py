"""Training-data operators: each module builds one operator on Spark DataFrames."""
