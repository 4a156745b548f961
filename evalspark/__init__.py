"""evalspark: model evaluation and keyed tabular preparation on Spark DataFrames."""
