"""Keep embeddings in step with a stream of changes."""
