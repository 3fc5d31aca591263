"""Scans of files and projections of tables."""
