"""Operators for building training data from texts. Nothing outside this subpackage imports it."""
