"""PySpark-native analytics for multi-object tracking tables."""
