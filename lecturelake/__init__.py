"""Analytics for recorded lectures at catalogue scale, on Spark DataFrames and Structured Streaming."""
