"""Siftline: analytics over source files, findings and training corpora on Spark DataFrames."""
