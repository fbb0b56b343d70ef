"""Land-cover streaming."""
