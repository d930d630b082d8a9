"""Feature synthesis and training-data operators on Spark DataFrames."""
