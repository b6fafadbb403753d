"""Helpers shared by the operators: bounded Arrow blocks, byte hashing in numpy, shared-folder tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, stored, written  # noqa: F401  (for the operators)

#: Bytes of text that one numpy pass works on (a single longer text is a pass of its own).
BLOCK_BYTES = 2 << 20
#: Bytes of rows that Spark hands to Python at once.
ARROW_BYTES = 16 << 20


def bounded_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")):
        try:
            spark.conf.set(key, value)
        except Exception:  # a cluster may fix these
            continue


def text_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of n + 1 rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into row ranges whose texts have at most limit bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_view(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def map_blocks(df: DataFrame, column: str, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """mapInArrow over blocks of bounded text size; make returns a batch or None."""
    bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column, limit):
            made = make(block)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


# --- numpy hashing -------------------------------------------------------------------------------------------------

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
UNSTEP = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random-looking odd value for each byte.
BYTE_KEY = mix(np.arange(1, 257, dtype=U) * STEP) | U(1)


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, I): the bytes raw[s:e] have the polynomial hash (S[e] - S[s]) * I[s], modulo 2**64."""
    n = len(raw)
    power = np.full(n + 1, STEP, U)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE_KEY[raw] * power[:n], out=sums[1:])
    inverse = power
    inverse[:] = UNSTEP
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return sums, inverse


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: tuple | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges raw[starts:ends], by content and length."""
    total, inverse = sums or prefix_sums(raw)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _chars(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each range as one number, zero beyond its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8").reshape(-1)
    bits = np.minimum(ends - starts, 8).astype(U) * U(8)
    return np.where(bits < 64, value & ((U(1) << (bits & U(63))) - U(1)), value)


#: Words of fewer bytes are their own number.
LONG_WORD = 8


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers of the byte ranges, which of them are long, the bytes of these). Shorter ranges have equal numbers only if they are equal."""
    size = ends - starts
    numbers = _chars(raw, starts, ends) | (np.minimum(size, LONG_WORD).astype(U) << U(56))
    long_ = np.nonzero(size >= LONG_WORD)[0]
    data = raw.tobytes()
    return numbers, long_, [data[s:e] for s, e in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: one to one below LONG_WORD bytes, a cryptographic digest from there on."""
    numbers, long_, words = word_numbers(raw, starts, ends)
    known = {w: hashlib.blake2b(w, digest_size=8).digest() for w in set(words)}
    numbers[long_] = np.frombuffer(b"".join([known[w] for w in words]), "<u8")
    return mix(numbers)


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of maximal runs of inside that don't cross a row's border."""
    n = len(inside)
    flags = np.zeros(n + 2, np.int8)
    flags[1 : n + 1] = inside
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    both = border & (flags[: n + 1] > 0) & (flags[1:] > 0)  # a word goes on beyond a border
    starts = np.nonzero(((flags[1:] > 0) & (flags[:-1] == 0)) | both)[0]
    ends = np.nonzero(((flags[1:] == 0) & (flags[:-1] > 0)) | both)[0]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, bytes of the column): the check before anything is gathered or broadcast."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()
    return int(n), int(size)
