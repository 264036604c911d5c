"""A PySpark-native engine for document-image text recognition pipelines."""
