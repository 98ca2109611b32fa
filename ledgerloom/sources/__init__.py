"""Readers, writers and append-only logs."""
