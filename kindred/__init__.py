"""kindred: a Spark-native engine for visual similarity, entity grouping and corpus preparation."""
