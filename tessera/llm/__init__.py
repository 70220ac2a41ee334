"""Operators for the preparation of training data. Nothing outside this package imports it."""
