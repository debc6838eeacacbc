"""Query plans: the registry of named queries with their oracle SQL."""
