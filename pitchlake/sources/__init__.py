"""Readers and writers of pages, records, tables and texts."""
