"""Spark-native processing of semi-structured job postings."""
