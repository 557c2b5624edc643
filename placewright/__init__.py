"""Analytics on place records with Spark DataFrames."""
