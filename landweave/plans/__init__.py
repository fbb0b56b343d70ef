"""Land-cover plans."""
