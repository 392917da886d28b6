"""Tidemark: a Spark-native engine for time-stamped decisions on priced instruments."""
