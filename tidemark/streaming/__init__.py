"""Stateful and windowed operators."""
