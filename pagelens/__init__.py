"""Website and answer-visibility analytics on Spark DataFrames."""
