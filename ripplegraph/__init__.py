"""Change-impact analytics over dependency graphs, expressed as Spark DataFrames."""
