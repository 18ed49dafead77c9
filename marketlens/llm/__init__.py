"""Operators for preparing language-model training data, one module each.

Nothing else in the library imports this package; ``registry`` lists its
queries for ``__spark_entry__.py``.
"""
