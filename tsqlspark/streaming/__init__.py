"""Empty: the dialect has no streams, so there are no streaming operators."""
