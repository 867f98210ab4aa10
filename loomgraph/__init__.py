"""Graph and corpus analytics on Spark DataFrames."""
