"""A Spark-native engine for typed tables, relational queries and data preparation."""
