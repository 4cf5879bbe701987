"""Structured Streaming form of the live feed."""
