"""A Spark-native engine for document recognition and text corpora."""
