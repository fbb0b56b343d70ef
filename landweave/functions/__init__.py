"""Land-cover functions."""
