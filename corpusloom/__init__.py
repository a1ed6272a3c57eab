"""Spark-native engine for multilingual instruction corpora and training-data pipelines."""
