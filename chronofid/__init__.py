"""Fidelity, utility and privacy scores for synthetic sequential tables, as Spark jobs."""
