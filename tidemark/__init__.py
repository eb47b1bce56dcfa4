"""A Spark-native engine for transaction-risk features, scoring and data preparation."""
