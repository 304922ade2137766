"""Operators for the preparation of training corpora. Nothing else in the library imports this package."""
