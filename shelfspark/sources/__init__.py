"""Sources of the backlog engine."""
