"""Table movement, reconciliation and run-log analytics on Spark DataFrames."""
