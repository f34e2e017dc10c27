"""scanforge: push-broom imaging analytics on Spark DataFrames."""
