"""quarrykit: a PySpark-native engine for auditing and curating training datasets."""
