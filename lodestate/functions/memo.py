"""Remembered child hashes of a branch, as MAP<TINYINT, BINARY>: Column expressions. A missing key has no hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert(memo: Column, nibble: Column, hash_: Column) -> Column:
    """Set a child's hash, whether or not it had one (map_concat alone refuses repeated keys)."""
    return F.map_concat(F.map_filter(memo, lambda k, _: k != nibble), F.create_map(nibble.cast("tinyint"), hash_))


def delete(memo: Column, nibble: Column) -> Column:
    return F.map_filter(memo, lambda k, _: k != nibble)


def clear(memo: Column, nibble: Column) -> Column:
    """Keep the child's place but forget its hash."""
    return F.transform_values(memo, lambda k, v: F.when(k != nibble, v))


def get(memo: Column, nibble: Column) -> Column:
    return F.try_element_at(memo, nibble.cast("tinyint"))


def exists(memo: Column, nibble: Column) -> Column:
    return F.map_contains_key(memo, nibble.cast("tinyint"))


def children(memo: Column) -> Column:
    """Mask of the nibbles that have a place."""
    return F.aggregate(F.map_keys(memo), F.lit(0), lambda mask, k: mask.bitwiseOR(F.pow(F.lit(2), k).cast("int")))


#: Branches of the state above this depth keep no memo.
TOP_LEVELS = 2


def stripped(memo: Column, path: Column, storage_path: Column) -> Column:
    """The memo as a snapshot keeps it: none for the topmost branches, nor for branches of two children at even depths.

    path is the account's for storage branches (and then as long as a key). Recomputing such branches is cheap.
    """
    depth = F.length(path) + F.length(storage_path)
    cheap = (F.length(path) < TOP_LEVELS) | ((F.size(memo) == 2) & (depth % 2 == 0))
    return F.when(cheap, F.transform_values(memo, lambda _, v: F.nullif(v, v))).otherwise(memo)
