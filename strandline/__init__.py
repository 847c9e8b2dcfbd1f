"""Spark-native analytics over ordered, time-stamped sequences."""
