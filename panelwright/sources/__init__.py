"""Readers, writers and the views that shape the given tables into a panel."""
