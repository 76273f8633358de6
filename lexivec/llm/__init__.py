"""Corpus operators for training data: language, duplicates, filters, privacy, tokens, mixing.

Nothing else in the package imports this subpackage. ``queries.py`` holds the registered queries.
"""
