"""Readers, page parsers and writers."""
