"""Operators for training-data pipelines.

Self-contained: nothing else in the library imports this subpackage, and it
needs nothing from the rest.
"""
