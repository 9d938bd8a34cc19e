"""Relational building blocks: matching, top-k, numbering, sync, duplicates."""
