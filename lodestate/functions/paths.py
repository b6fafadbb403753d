"""Nibble paths as upper-case hex strings, one character a nibble: Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCOUNT, STORAGE, MERKLE = 0, 1, 2
PATH_LENGTH = 64


def parse(hex_text: Column) -> Column:
    """Path of a hex string, with or without 0x; null if it isn't hex."""
    bare = F.upper(F.regexp_replace(hex_text, "^0[xX]", ""))
    return F.when(bare.rlike("^[0-9A-F]*$"), bare)


def from_key(key: Column, nibble_from: int = 0) -> Column:
    """Path of a BINARY key from a nibble on."""
    return F.substr(F.hex(key), F.lit(nibble_from + 1))


def from_nibbles(nibbles: Column) -> Column:
    """Path of an array of nibbles."""
    return F.array_join(F.transform(nibbles, lambda n: F.hex(n.cast("long"))), "")


def slice_path(path: Column, start: int = 0, length: int | None = None) -> Column:
    return F.substr(path, F.lit(start + 1), F.lit(length)) if length is not None else F.substr(path, F.lit(start + 1))


def nibble_at(path: Column, at: int) -> Column:
    return F.conv(F.substring(path, at + 1, 1), 16, 10).cast("int")


def append(path: Column, *others: Column) -> Column:
    return F.concat(path, *others)


def to_key(path: Column) -> Column:
    """BINARY of an even path."""
    return F.unhex(path)


def only_zeroes(path: Column) -> Column:
    return path.rlike("^0*$")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading nibbles that both have; 0 if either is empty."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), True)
    return F.when(n == 0, F.lit(0)).when(differs == 0, n).otherwise(differs - 1).cast("int")


def is_state(kind: Column, path: Column) -> Column:
    """Accounts, and trie nodes above the account level, live in the state tree; all else belongs to an account."""
    return (kind == ACCOUNT) | ((kind == MERKLE) & (F.length(path) < PATH_LENGTH))


def under(df: DataFrame, prefix: str, path: str = "path", pruned: str | None = "nib01") -> DataFrame:
    """Rows whose path begins with prefix. The partition column of leading nibbles, if there, gets its own predicate."""
    prefix = prefix.upper()
    out = df.where(F.col(path).startswith(prefix))
    if pruned and pruned in df.columns and prefix:
        out = out.where(F.lit(prefix).startswith(F.col(pruned)) | F.col(pruned).startswith(prefix))
    return out


def key_hash(path: Column, kind: Column, storage_path: Column) -> Column:
    """64-bit hash of a key for filters."""
    return F.xxhash64(path, kind, storage_path)


#: Selectors of first nibbles: name -> (lowest, highest).
SELECTORS = {"all": (0, 15), "half_low": (0, 7), "half_high": (8, 15), "q0": (0, 3), "q1": (4, 7), "q2": (8, 11), "q3": (12, 15)}


def selected(path: Column, selector: str) -> Column:
    low, high = SELECTORS[selector]
    return nibble_at(path, 0).between(low, high)


def part_of(path: Column, parts: int) -> Column:
    """Which of 1, 2, 4 or 8 parts a key belongs to, by the low bits of its first nibble; null for an empty path."""
    if parts not in (1, 2, 4, 8):
        raise ValueError("1, 2, 4 or 8 parts")
    return F.when(F.length(path) > 0, nibble_at(path, 0) % parts)


def single(nibble: Column) -> Column:
    """Path of one nibble."""
    return F.hex(nibble.cast("long"))


def is_boundary_leaf(node_path: Column) -> Column:
    """Leaves whose path is longer than a key hold a hash beyond the synced range."""
    return F.length(node_path) > PATH_LENGTH


def boundary_hash(node_path: Column) -> Column:
    """The hash that such a leaf's path ends with; null for other leaves."""
    return F.when(is_boundary_leaf(node_path), F.unhex(F.right(node_path, F.lit(PATH_LENGTH))))
