"""Corvane: a Spark-native engine for code and document corpora."""
