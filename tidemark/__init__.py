"""Tidemark: drift analytics for soft clusterings, written for Spark DataFrames."""
