"""A PySpark-native engine for structuring, searching and preparing documents."""
