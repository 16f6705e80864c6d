"""Grounded content analytics on Spark: DataFrame operators over document corpora."""
