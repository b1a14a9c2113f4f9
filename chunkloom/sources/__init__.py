"""Sources of documents and the embedding cache."""
