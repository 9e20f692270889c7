"""Readers, writers and dataset metadata."""
