"""Structured Streaming over pages. Each page is a record, so nothing keeps state."""
