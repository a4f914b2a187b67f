"""tessellar: a PySpark-native engine for document memories with an entity graph."""
