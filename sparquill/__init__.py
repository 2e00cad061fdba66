"""Text-corpus and instruction-data analytics written directly for Spark DataFrames."""
