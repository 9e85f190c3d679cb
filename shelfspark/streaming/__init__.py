"""Streaming of the backlog engine."""
