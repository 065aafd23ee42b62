"""Plan patterns that keep operators safe at scale (hot keys, long orders, ranges)."""
