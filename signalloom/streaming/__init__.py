"""Incremental runs driven by newly landed files."""
