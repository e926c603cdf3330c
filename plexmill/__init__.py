"""A Spark-native analytics engine for repository and entity knowledge."""
