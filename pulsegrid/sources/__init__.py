"""Batch, streaming and synthetic sources."""
