"""Analytics on hierarchical, time-versioned document corpora, as Spark DataFrames."""
