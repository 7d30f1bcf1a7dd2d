"""Web-surface analytics as Spark DataFrames."""
