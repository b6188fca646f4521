"""Stored listing pages to tables of records, as Spark DataFrames."""
