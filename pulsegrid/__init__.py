"""PySpark-native analytics over frame-based signal and event streams."""
