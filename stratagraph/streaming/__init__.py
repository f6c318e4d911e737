"""Incremental ingestion and windowed views over streams."""
