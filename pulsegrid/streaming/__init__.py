"""Ordered and stateful operators, and streaming sinks."""
