"""DataFrame operators: one module for each part of the work."""
