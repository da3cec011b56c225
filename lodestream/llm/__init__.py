"""Operators that prepare training data from large document collections."""
