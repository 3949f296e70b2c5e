"""Operators for training-data work; nothing else in the library imports this package."""
