"""Document analytics on Spark: see README.md."""
