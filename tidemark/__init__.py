"""tidemark: a Spark-native engine for benchmark analytics and corpus preparation."""
