"""Receipts analytics on Spark: spend insights, archive queries, replication,
extraction merge and table maintenance as pure DataFrame functions."""
