"""Plan-level helpers: shipping code to workers, sessions, staging."""
