"""lontar: text-corpus analytics on PySpark (DataFrames, SQL, Structured Streaming)."""
