"""Operators on logs, extents, names, metadata and traces."""
