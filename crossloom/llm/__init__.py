"""Operators of a training-data pipeline over the tables ``documents``, ``pages`` and ``embeddings``.

Nothing else in the package imports this one. ``queries.py`` registers the thin queries.
"""
