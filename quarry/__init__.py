"""A PySpark-native engine for curves, sections and detections."""
