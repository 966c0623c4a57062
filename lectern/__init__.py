"""lectern: document analytics, hybrid retrieval and corpus preparation on Spark DataFrames."""
