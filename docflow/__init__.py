"""docflow: document analytics on Spark DataFrames."""
