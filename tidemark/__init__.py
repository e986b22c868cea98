"""Tidemark: a PySpark-native engine for bitemporal marine observations and advisory text."""
