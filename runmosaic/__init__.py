"""Mask, tile and detection analytics as Spark DataFrame operators."""
