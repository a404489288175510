"""streaming of quantaloom."""
