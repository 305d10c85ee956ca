"""tracewright: event-log analytics on Spark DataFrames."""
