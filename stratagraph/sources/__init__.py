"""Data sources: version-control history, blobs, tables of other systems."""
