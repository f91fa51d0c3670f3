"""A time-series store and analytics engine on Spark DataFrames."""
