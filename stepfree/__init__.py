"""Spark-native analytics for accessible walking networks."""
