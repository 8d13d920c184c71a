"""Spark-native transaction-risk analytics: features, re-balancing, models, evaluation, monitoring, streams."""
