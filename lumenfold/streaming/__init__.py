"""Stateful operators under Structured Streaming."""
