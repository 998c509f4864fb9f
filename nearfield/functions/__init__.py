"""Column builders and small per-batch helpers."""
