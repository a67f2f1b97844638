"""Operators that prepare training data from the store. Nothing outside this package imports it."""
