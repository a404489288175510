"""sources of quantaloom."""
