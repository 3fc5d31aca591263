"""Plan building blocks: checkpoints, skew, ordered scans, the query catalogue."""
