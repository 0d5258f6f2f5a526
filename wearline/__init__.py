"""Run-to-failure analytics on Spark DataFrames."""
