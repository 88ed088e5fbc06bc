"""Queries of the driver contract and their SQL."""
