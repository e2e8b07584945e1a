"""Tidemark: persistence analysis of time series and text-corpus preparation on Spark."""
