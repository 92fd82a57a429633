"""foldlog: log folding and replay-validation analytics on Spark DataFrames."""
