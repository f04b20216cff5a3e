"""DataFrame operators over topic tables."""
