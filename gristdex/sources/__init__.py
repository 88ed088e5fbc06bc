"""Reading, loading, merging and exporting index tables."""
