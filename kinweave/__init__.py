"""Multi-source profile unification on Spark DataFrames."""
