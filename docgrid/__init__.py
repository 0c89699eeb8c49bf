"""Document-page recognition pipelines as Spark DataFrames."""
