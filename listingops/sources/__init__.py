"""Dimensions with fixed values, readers of raw tables, and report writers."""
