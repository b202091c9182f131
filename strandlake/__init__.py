"""Spark-native evaluation and correction of sequence assemblies."""
