"""A change-log analytics engine on Spark DataFrames."""
