"""Operators for large text corpora: fixity, fingerprints, language models, filters, scans.

Every module holds one operator.  The thin contract queries live in ``queries.py``;
nothing outside this subpackage imports it.
"""
