"""Readers of files and of the derived input views."""
