"""Readers, derived views and sinks."""
