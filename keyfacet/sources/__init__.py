"""Sources and the index store."""
