"""Relational and graph kernels: DataFrame in, DataFrame out, columns named by the caller."""
