"""Spark-native analytics for populations of sequencing reads."""
