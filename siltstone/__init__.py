"""siltstone: a PySpark-native crawl, extraction and training-data engine."""
