"""Relational building blocks: deduplication, joins, top-k and table maintenance."""
