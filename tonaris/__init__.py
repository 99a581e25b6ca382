"""Analytics on ordered, multi-channel sample streams, built on Spark DataFrames."""
