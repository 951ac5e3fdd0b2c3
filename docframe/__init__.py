"""docframe: document-collection analytics on Spark DataFrames."""
