"""Spark-native source-code analytics: extraction, lint, call graph, index, retrieval, prompts."""
