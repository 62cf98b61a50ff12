"""Spark-native analytics for paired-contrast comparative genomics."""
