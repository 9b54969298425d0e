"""Readers, writers and exactly-once appends."""
