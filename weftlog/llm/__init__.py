"""Operators for training data: sequences, frequent items, tokens, leaks and spam pages."""
