"""Training-data operators: deduplication, tokenisation, personal data, fingerprints, quality, contamination,
page extraction, archives and conversations.  Nothing outside this package imports it."""
