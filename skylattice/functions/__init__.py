"""Column expressions: sky geometry, names, sentinels."""
