"""Operators and queries for building training data."""
