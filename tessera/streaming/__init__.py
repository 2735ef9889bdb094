"""Structured Streaming extras over event tables."""
