"""Operators for preparing text as training data; nothing else in the library imports them."""
