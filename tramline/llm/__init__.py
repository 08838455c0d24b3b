"""Operators for preparing large text corpora.

Nothing else in ``tramline`` imports this subpackage; it can be removed as a whole.
"""
