"""wordloom: visual-word analytics on Spark DataFrames."""
