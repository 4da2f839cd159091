"""Queries that bind the kernels to the star schema, and their SQL."""
