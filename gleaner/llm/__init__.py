"""Operators for cleaning, encoding and packing training corpora."""
