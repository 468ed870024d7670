"""Training-data pipeline operators: sharding, deduplication, tokenising,
pseudonyms, packing, scoring, search, quality rules and page extraction.

Nothing else in the library imports this subpackage."""
