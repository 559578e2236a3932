"""Spark-native analytics for perturbation screens and their knowledge sources."""
