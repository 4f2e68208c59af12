"""Operators for large training-data collections. Nothing outside this folder imports it."""
