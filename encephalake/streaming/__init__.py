"""Structured Streaming forms of ingest, quality monitoring and markers."""
