"""Evaluation analytics on Spark: responses in, metrics out."""
