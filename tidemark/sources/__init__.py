"""Readers, writers, dimensions and the projection views of the driver's tables."""
