"""Spark-native analytics for sparse yearly measurements on linear networks."""
