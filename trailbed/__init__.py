"""Spark-native analytics over coding-agent transcripts.

Every operator takes DataFrames and returns a lazy DataFrame; nothing here reads
environment variables or keeps state on the driver.
"""
