"""Data model: vocabularies, schemas, keyed merges, storage, sanitising."""
