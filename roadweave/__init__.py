"""roadweave: a Spark-native engine for directed road-network conflation."""
