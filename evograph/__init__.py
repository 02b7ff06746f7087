"""Analytics on evolving graphs over Spark DataFrames."""
