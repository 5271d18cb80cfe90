"""Document ingestion and hybrid vector / full-text search on Spark DataFrames."""
