"""Numeric kernels in numpy: no Spark in here, one series or panel at a time."""
