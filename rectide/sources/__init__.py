"""Readers, writers and test-table mappings."""
