"""DataFrame operators of the incremental index."""
