"""operators of quantaloom."""
