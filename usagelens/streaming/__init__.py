"""Structured Streaming jobs: the same rules as the batch operators, batch by batch."""
