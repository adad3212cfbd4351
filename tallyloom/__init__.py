"""Spark-native engine for typed decision data and training-corpus preparation."""
