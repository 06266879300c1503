"""Fan-out-safe semantic metrics over Spark DataFrames."""
