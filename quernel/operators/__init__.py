"""Statistics, versions, locks and integrity checks."""
