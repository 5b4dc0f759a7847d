"""Vocabulary, embedding and measurement analytics on Spark DataFrames."""
