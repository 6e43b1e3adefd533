"""A PySpark-native engine for message history and duplicate detection."""
