"""Timberline: server-log analytics expressed as Spark DataFrames."""
