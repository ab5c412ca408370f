"""Spark-native behaviour analytics for event logs."""
