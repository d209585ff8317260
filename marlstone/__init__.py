"""marlstone: a PySpark-native engine for table-and-text corpora."""
