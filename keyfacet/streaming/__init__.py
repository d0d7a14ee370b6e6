"""Incremental ingest of a folder of documents."""
