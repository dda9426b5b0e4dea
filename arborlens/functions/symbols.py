"""Scalar symbolisers and report arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Caps of the small alphabets and the probability precision.
UINT_CAP, INT_LOW, INT_HIGH, LENGTH_CAP, PRECISION = 8, -1, 6, 16, 1 << 18
MISS = "MISS"


def bool_index(v: Column) -> Column:
    return v.cast("int")


def uint_index(v: Column) -> Column:
    """0..7, and 8 for all that is larger."""
    return F.least(v, F.lit(UINT_CAP)).cast("int")


def int_index(v: Column) -> Column:
    """-1..6 become 0..7; the rest is 8."""
    return F.when(v.between(INT_LOW, INT_HIGH), v + 1).otherwise(UINT_CAP).cast("int")


def length_index(n: Column) -> Column:
    return F.least(n, F.lit(LENGTH_CAP)).cast("int")


def enum_index(v: Column, variants: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, variants)), v) - 1).cast("int")


def capped_name(index: Column, cap: int, shift: int = 0) -> Column:
    return F.when(index < cap, (index + shift).cast("string")).otherwise(MISS)


def array_label(i: Column, n: Column) -> Column:
    """The key of an array element that is itself the location: exact in short arrays, coarse in long ones."""
    return F.when(n <= 4, F.concat(i.cast("string"), F.lit("-of-"), n.cast("string"))).when(i <= 4, F.concat(i.cast("string"), F.lit("-of-many"))).otherwise("*")


def bits(p: Column) -> Column:
    return -F.log2(p)


def floor_to(x: Column, k: int) -> Column:
    """Truncated to multiples of 1 / k."""
    return F.floor(x * k) / k


def slash_count(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit("/")))).cast("int")


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def varuint_bits(v: Column, compat: bool = False) -> Column:
    """Bits of the size class of a variable-length unsigned integer.

    ``compat`` keeps two slips: the 21-bit class ends at 2^17, and the largest class is charged 28 bits.
    """
    return F.when(v < 0x80, 8).when(v < 0x4000, 16).when(v < (0x20000 if compat else 0x200000), 24).otherwise(28 if compat else 32).cast("int")


def string_header_bytes(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).otherwise(4).cast("int")


F64_BITS = 64
