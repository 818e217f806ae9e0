"""Market analytics for repeatedly observed, priced entities, on Spark DataFrames."""
