"""recollect: a PySpark-native engine for recorded knowledge."""
