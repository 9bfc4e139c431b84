"""Recommendation analytics on Spark: load interactions, encode, train, score, publish, monitor."""
