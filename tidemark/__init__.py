"""tidemark: labour-market analytics as lazy Spark DataFrames."""
