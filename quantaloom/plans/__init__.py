"""plans of quantaloom."""
