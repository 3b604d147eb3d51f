"""Dataset engine on Spark DataFrames."""
