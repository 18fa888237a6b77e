"""A Spark-native engine for analysing text corpora."""
