"""Structured Streaming forms of ingestion, coalescing, projection and hit rates."""
