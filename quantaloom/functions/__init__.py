"""functions of quantaloom."""
