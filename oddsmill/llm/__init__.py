"""Operators for building training data: one module per operator, queries in ``queries.py``.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so either half can be removed without the other noticing.
"""
