"""PySpark-native analytics over page, text-line, raster and landed HTML tables."""
