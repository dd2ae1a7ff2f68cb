"""Operators of a training-data pipeline: large-scale operators on texts and vectors, and their queries.

Nothing outside this package imports it.
"""
