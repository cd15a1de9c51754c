"""DataFrame operators over timelines, ledgers and job tables."""
