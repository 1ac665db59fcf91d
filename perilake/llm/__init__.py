"""Operators for training text: cleaning, duplicates, leaks, formats and classifiers."""
