"""Selected-basis eigenvalue analytics on Spark DataFrames."""
