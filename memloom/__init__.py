"""A memory engine on DataFrames: an append-only log of typed records, and all that follows from it."""
