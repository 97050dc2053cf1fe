"""Structured Streaming: hits, visits and buckets as they come, and imports by day."""
