"""Operators for large text collections used as training data."""
