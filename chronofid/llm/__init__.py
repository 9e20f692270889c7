"""Operators for training-data pipelines over a ``documents`` table, one module each."""
