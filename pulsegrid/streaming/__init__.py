"""Structured Streaming: the same machines as keyed state, event-time deduplication and windows."""
