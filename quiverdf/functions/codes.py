"""Functions of code vectors: integer products, packing of nibbles and of bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_dot(a: Column | str, b: Column | str) -> Column:
    """Exact product of two code vectors."""
    pairs = F.zip_with(_col(a).cast("array<bigint>"), _col(b).cast("array<bigint>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def pack_nibbles(codes: Column | str) -> Column:
    """Two codes of 4 bits in each byte, the first of a pair in the low half; an odd last one stands alone."""
    c = _col(codes).cast("array<int>")
    pairs = F.sequence(F.lit(0), F.ceil(F.size(c) / 2).cast("int") - 1)
    packed = F.transform(pairs, lambda i: F.get(c, 2 * i) + 16 * F.coalesce(F.get(c, 2 * i + 1), F.lit(0)))
    return F.when(F.size(c) > 0, packed).otherwise(F.array().cast("array<int>"))


def unpack_nibbles(packed: Column | str, n: Column | int) -> Column:
    """The first ``n`` codes that ``pack_nibbles`` packed."""
    halves = F.flatten(F.transform(_col(packed), lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))
    return F.slice(halves, 1, F.lit(n) if isinstance(n, int) else n)


def packed_dot(a: Column | str, b: Column | str) -> Column:
    """Product of two packed nibble vectors, without unpacking them first."""
    low = F.zip_with(_col(a), _col(b), lambda x, y: x.bitwiseAND(15) * y.bitwiseAND(15) + F.shiftright(x, 4) * F.shiftright(y, 4))
    return F.aggregate(low.cast("array<bigint>"), F.lit(0).cast("bigint"), lambda s, x: s + x)


def pack_bits(bits: Column | str) -> Column:
    """Words of 32 bits (as non-negative longs), the first bit lowest."""
    c = _col(bits).cast("array<bigint>")
    words = F.sequence(F.lit(0), F.ceil(F.size(c) / 32).cast("int") - 1)

    def word(w: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda s, k: s + F.coalesce(F.get(c, 32 * w + k), F.lit(0)) * F.pow(F.lit(2.0), k).cast("bigint"))

    return F.when(F.size(c) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def bits_dot(a: Column | str, b: Column | str) -> Column:
    """How many bits are set in both of two packed bit vectors."""
    both = F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("bigint"))
    return F.aggregate(both, F.lit(0).cast("bigint"), lambda s, x: s + x)
