"""quiverlake: vector search and vector data preparation on Spark DataFrames."""
