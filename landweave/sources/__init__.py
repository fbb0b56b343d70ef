"""Land-cover sources."""
