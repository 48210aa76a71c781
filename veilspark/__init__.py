"""Sensitive-text analytics on Spark: detection, redaction, receipts, vault and corpus preparation."""
