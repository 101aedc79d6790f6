"""tessera: a PySpark-native analytics engine for civic text, directory and activity data."""
