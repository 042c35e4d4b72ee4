"""anchorframe: event-anchored case/control analytics on Spark DataFrames."""
