"""Operators for training data. Nothing outside this subpackage imports it."""
