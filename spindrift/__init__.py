"""Record linkage at scale on Spark DataFrames: blocking, retrieval, pair features, decisions and their checks."""
