"""Spark operators for multi-sensor planetary observation tables."""
