"""Keyed tables on Spark, and operators for training data."""
