"""Queries over the driver tables, one per operator, each with its SQL counterpart."""
