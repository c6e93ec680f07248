"""tidewell: event-stream analytics on Spark DataFrames."""
