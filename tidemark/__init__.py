"""Tidemark: documentation-claim analytics and training-data operators on Spark DataFrames."""
