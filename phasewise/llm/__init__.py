"""Operators for preparing large text, page and vector collections as training data."""
