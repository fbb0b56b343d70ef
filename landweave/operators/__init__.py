"""Land-cover operators."""
