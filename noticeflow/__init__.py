"""Spark-native processing of public notices: extraction, classification, lifecycle, search."""
