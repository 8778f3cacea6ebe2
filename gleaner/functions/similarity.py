"""Hashes, distances and set similarities as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(content: Column | str) -> Column:
    return F.sha2(content, 256)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit integers."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column | str, n: int) -> Column:
    """Bit i is set where component i exceeds component i + 1, for i below ``n`` (at most 63)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(v, i) > F.get(v, i + 1), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def bigrams(text: Column | str) -> Column:
    """All overlapping pairs of characters, repeats included; none for texts shorter than two."""
    t = F.col(text) if isinstance(text, str) else text
    # a substring by position is searched from the start, so long texts are cut into overlapping pieces first
    pieces = F.filter(F.regexp_extract_all(t, F.lit("(?s)(?=(.{1,65})).{1,64}"), F.lit(1)), lambda p: F.length(p) > 1)
    pairs = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))))
    return F.when(F.length(t) > 1, pairs).otherwise(F.expr("cast(array() as array<string>)"))


def similarity_ratio(threshold: int) -> float:
    """The share of common bigrams that a bit threshold stands for."""
    return min(0.999, max(0.5, 1 - threshold / 64))
