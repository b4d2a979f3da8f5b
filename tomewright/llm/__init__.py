"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its registered queries are
in ``queries.py``, their SQL in ``oracles.py``.
"""
