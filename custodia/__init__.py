"""Data governance on Spark: find, mask, gate, check, audit and compare data at scale."""
