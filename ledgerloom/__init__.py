"""A reconciliation and training-data engine on Spark DataFrames."""
