"""polyglint: localization-catalog analytics on Spark DataFrames."""
