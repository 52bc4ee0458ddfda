"""Spark-native curation, geometry and evaluation of annotated screen datasets."""
