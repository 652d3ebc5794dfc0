"""Knowledge graphs from text and tables, on Spark DataFrames."""
