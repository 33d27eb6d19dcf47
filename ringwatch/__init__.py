"""Spark-native abuse-analytics engine: DataFrame plans over platform tables."""
