"""Batch operators, grouped by what they measure."""
