"""kgspark: a PySpark-native engine for knowledge-graph analytics over document collections."""
