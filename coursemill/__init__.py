"""Learning analytics, recommendation and corpus preparation on Spark DataFrames."""
