"""Declarative data quality and referential integrity over Spark DataFrames."""
