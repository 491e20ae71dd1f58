"""Named queries: listings, search, feeds, rollups, each with its SQL twin."""
