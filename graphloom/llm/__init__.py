"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``queries.py`` lists one query
per operator, ``shared.py`` holds what several of them need.
"""
