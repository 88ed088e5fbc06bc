"""Structured Streaming ingestion of postings."""
