"""Evidence-grounded text analytics on Spark DataFrames."""
