"""tidemark: partitioned, append-only event logs as Spark DataFrames."""
