"""Spark-native detection of confidential vocabulary in large text collections."""
