"""Column helpers, layout helpers and small numpy kernels."""
