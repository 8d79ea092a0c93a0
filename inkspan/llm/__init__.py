"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.
"""
