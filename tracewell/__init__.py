"""PySpark-native log detection, correlation and timeline analytics."""
