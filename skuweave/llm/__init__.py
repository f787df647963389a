"""Operators for preparing language-model training corpora.  Nothing outside this package imports it."""
