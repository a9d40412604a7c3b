"""Structured Streaming: incremental ingestion and keyed interval maps."""
