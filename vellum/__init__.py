"""Spark-native document analytics: text operators, relational analytics, step pipelines, streams."""
