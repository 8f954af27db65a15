"""Training-data operators: filters, deduplication, scoring and tokenisation on Spark DataFrames."""
