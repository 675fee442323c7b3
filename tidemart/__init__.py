"""A PySpark-native analytics engine for retail marts, enrichment and evaluation."""
