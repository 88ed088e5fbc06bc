"""Scalar helpers and column functions."""
