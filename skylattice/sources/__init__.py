"""Catalogue readers and writers."""
