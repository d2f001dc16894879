"""Document and business-table analytics written for Spark DataFrames."""
