"""meshwork: community analytics on large weighted graphs, built from Spark DataFrames."""
