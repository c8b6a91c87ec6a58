"""lexloom: text preparation on Spark DataFrames around sparse word representations."""
