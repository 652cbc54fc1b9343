"""Composed plans: the whole analysis, and the registered queries with their SQL."""
