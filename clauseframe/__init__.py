"""PySpark-native analytics over agreements and other long texts."""
