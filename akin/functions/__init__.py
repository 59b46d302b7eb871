"""Scalar functions: pure kernels and their column forms."""
