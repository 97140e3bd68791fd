"""Identity matching and its evaluation, expressed on Spark DataFrames."""
