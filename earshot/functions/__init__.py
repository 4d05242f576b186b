"""Column builders and numpy kernels."""
