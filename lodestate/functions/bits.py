"""Sets of nibbles as 16-bit masks, and hex helpers: Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often it is used: nested encodings don't multiply."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def mask_of(nibble: Column) -> Column:
    return F.pow(F.lit(2), nibble).cast("int")


def count(mask: Column) -> Column:
    return F.bit_count(mask)


def has(mask: Column, nibble: Column) -> Column:
    return F.getbit(mask, nibble) == 1


def rank(mask: Column, nibble: Column) -> Column:
    """Members up to and with the nibble."""
    return F.bit_count(mask.bitwiseAND((F.pow(F.lit(2), nibble + 1) - 1).cast("int")))


def smallest(mask: Column) -> Column:
    """Lowest member; null for the empty set."""
    return F.when(mask != 0, F.bit_count(mask.bitwiseAND(-mask) - 1))


def largest(mask: Column) -> Column:
    """Highest member; null for the empty set."""
    return F.when(mask != 0, F.length(F.bin(mask)) - 1)


def smallest_missing(mask: Column) -> Column:
    """Lowest nibble that isn't a member; 16 for the full set."""
    rest = F.bitwise_not(mask)
    return F.bit_count(rest.bitwiseAND(-rest) - 1)


def to_hex(value: Column, prefixed: bool = True) -> Column:
    return F.concat(F.lit("0x" if prefixed else ""), F.lower(F.hex(value)))


def without_leading_zeros(value: Column) -> Column:
    """BINARY without leading zero bytes; a zero byte if nothing is left."""
    return let(F.regexp_replace(F.hex(value), "^(00)+", ""), lambda bare: F.unhex(F.when(bare == "", F.lit("00")).otherwise(bare)))


def minimal(value: Column) -> Column:
    """Big-endian integer without leading zero bytes; empty for zero."""
    return F.unhex(F.regexp_replace(F.hex(value), "^(00)+", ""))


def padded32(value: Column) -> Column:
    """Big-endian integer as 32 bytes, so that BINARY order is numeric order."""
    return F.unhex(F.lpad(F.hex(value), 64, "0"))


def uint_bytes(value: Column) -> Column:
    """Minimal big-endian bytes of a non-negative BIGINT."""
    even = lambda text: F.when(text == "0", F.lit("")).when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text)
    return F.unhex(let(F.hex(value.cast("long")), even))
