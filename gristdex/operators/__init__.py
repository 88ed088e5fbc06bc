"""Operators over postings and result bags."""
