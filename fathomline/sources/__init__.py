"""Readers. Every reader gives source_file and seq: rows of a file have an order that means something."""
