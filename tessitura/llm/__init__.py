"""Operators for training data: text, near-duplicates and vectors.

Nothing outside this subpackage imports it.
"""
