"""PySpark-native decoding, comparison and auditing of financial wire messages."""
