"""Structured Streaming: the same pairs as the batch jobs."""
