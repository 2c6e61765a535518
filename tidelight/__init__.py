"""Spark-native operators for underwater spectrum archives joined with satellite scenes."""
