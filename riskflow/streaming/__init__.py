"""Structured Streaming jobs: velocity windows, dead letters, stateful scoring."""
