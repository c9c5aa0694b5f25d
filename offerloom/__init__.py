"""Batch analytics for campaign-response data on Spark DataFrames."""
