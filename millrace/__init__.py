"""millrace: a functional, collection-style analytics layer on Spark DataFrames."""
