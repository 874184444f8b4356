"""neurolake: a PySpark-native analytics engine for multi-channel electrophysiology."""
