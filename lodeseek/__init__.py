"""A PySpark-native hybrid retrieval engine: scan, chunk, de-duplicate, index, search."""
