"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` holds its
registered queries and their SQL.
"""
