"""A Spark-native engine for indexing, searching and preparing text and code corpora."""
