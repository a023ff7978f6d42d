"""strataline: a PySpark-native engine for feature-based rigid alignment of 3D scalar volumes."""
