"""Document, retrieval and conversation analytics, declared on Spark DataFrames."""
