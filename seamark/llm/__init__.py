"""Operators for text and training data. Nothing outside this subpackage imports it."""
