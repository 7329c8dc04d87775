"""Document-structure analytics on Spark: pages, lines, regions and blocks as DataFrames."""
