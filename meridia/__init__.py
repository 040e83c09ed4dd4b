"""Spark-native measurement, ranking and trajectory analytics."""
