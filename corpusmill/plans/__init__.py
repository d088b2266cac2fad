"""Planning, staging, and the archive as a whole."""
