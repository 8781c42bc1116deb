"""Fingerprints as sorted on-bits, and as packed words; all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_BITS = 2048


def clean_bits(c: Column, n_bits: int = N_BITS) -> Column:
    """Sorted distinct on-bits within range; null for a null array."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda b: b.isNotNull() & (b >= 0) & (b < n_bits))))


def pack_words(bits: Column, n_bits: int = N_BITS) -> Column:
    """Words of 64 bits, bit ``b`` in word ``b // 64``: one pass over the on-bits."""
    empty = F.array_repeat(F.lit(0).cast("long"), n_bits // 64)
    by_word = F.transform(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)), lambda w: F.aggregate(F.filter(bits, lambda b: F.shiftright(b, 6) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int")))))
    return F.when(F.size(bits) > 0, by_word).otherwise(empty)


def unpack_words(words: Column, n_bits: int = N_BITS) -> Column:
    """Sorted on-bits of packed words."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda b: F.getbit(F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two sets of on-bits; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)
