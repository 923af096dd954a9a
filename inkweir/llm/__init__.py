"""Operators for preparing training data from a document corpus (nothing else in the library imports this)."""
