"""Streaming reads and event-time rollups."""
