"""Rules, adapters and the query catalogue."""
