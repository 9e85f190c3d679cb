"""Operators of the backlog engine."""
