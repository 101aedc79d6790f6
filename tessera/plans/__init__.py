"""Named queries with their SQL."""
