"""Column-level operators over catalogues."""
