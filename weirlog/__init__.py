"""A Spark-native engine for mining templates from large tables of log messages."""
