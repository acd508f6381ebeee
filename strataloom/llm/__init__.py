"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the entry module adds its queries
only when it is present.
"""
