"""Operators for preparing language-model training corpora at scale.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query for each
operator; every operator takes and returns DataFrames.
"""
