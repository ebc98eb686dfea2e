"""pickwise: decision-record analytics on Spark DataFrames."""
