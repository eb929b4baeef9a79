"""Range analytics on Spark: exact and accuracy-bounded rectangle aggregates."""
