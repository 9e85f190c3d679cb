"""Functions of the backlog engine."""
