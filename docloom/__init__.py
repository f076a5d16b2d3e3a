"""docloom: a PySpark-native engine for indexing and searching document collections."""
