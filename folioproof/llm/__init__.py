"""Operators for language-model training corpora."""
