"""Emberfield: thermal hotspot analytics written as Spark DataFrame code."""
