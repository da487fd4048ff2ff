"""Readers that turn captured bodies into rows."""
