"""Customer-panel analytics and training-data operators on Spark DataFrames."""
