"""Readers with rejected rows, and writers that never overwrite."""
