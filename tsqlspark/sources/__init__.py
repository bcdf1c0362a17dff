"""The catalog and the versioned store of tables."""
