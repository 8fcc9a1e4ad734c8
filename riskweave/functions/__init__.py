"""Column-level helpers: no jobs, no Python per row."""
