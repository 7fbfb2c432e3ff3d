"""A rule engine and analytics library that plans everything as Spark DataFrames."""
