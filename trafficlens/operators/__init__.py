"""DataFrame operators over the log."""
