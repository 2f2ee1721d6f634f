"""Streaming of the catalogue library."""
