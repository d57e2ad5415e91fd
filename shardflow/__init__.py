"""Sharded key/value dataflow on Spark DataFrames."""
