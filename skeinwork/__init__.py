"""Retrieval, answer-evaluation and corpus-preparation operators on Spark DataFrames."""

__version__ = "0.1.0"
