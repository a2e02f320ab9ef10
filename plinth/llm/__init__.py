"""Operators for training-data problems. Nothing outside this package imports it."""
