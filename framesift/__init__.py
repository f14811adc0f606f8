"""Frame, label and corpus analytics on Spark DataFrames."""
