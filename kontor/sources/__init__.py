"""Readers, writers and table snapshots."""
