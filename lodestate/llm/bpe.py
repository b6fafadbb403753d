"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts texts where their content says so, so that documents with common passages have
common chunks. A task encodes each distinct chunk once and keeps its ids. Where two chunks meet, the ids near the
join may differ from those of the whole text; the join is repaired by encoding the text around it again. The window
grows over whole chunks until both of its ends are places at which the pre-tokenizer must begin a new word whatever
stands around it: beyond such a place a chunk's ids and the whole text's agree exactly, and nothing is left to compare.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._batches import BYTE_KEY, U, bounded_arrow, blocks, mix, text_view

# The pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A chunk has about this many bytes (a power of two).
CHUNK_BYTES = 512
#: Bytes of chunks and joins that a task keeps; then it starts to gather anew.
CACHE_BYTES = 48 << 20
#: Between a letter and a space with a letter behind it a new word begins, whatever comes before or after.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
_LAST_SAFE = re.compile(r".*[A-Za-z](?= [A-Za-z])", re.DOTALL)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes -> id, special string -> id) of a byte-level BPE file of the tokenizers library whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    letters = byte_alphabet()
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}, special


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], chunk_bytes: int = CHUNK_BYTES, cache_bytes: int = CACHE_BYTES) -> None:
        self.plain = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.mask, self.cache_bytes = U(chunk_bytes - 1), cache_bytes
        self.chunks: dict[str, tuple[bytes, str | None, str]] = {}
        self.joins: dict[str, bytes] = {}
        self.held = 0

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        return self.plain.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def cut(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted places at which a chunk begins: the rows' borders, and where the hash of the 16 bytes before says so."""
        n = len(raw)
        if n <= 16:
            return np.unique(offsets)
        h, step = BYTE_KEY[raw], 0x9E3779B97F4A7C15
        for width in (1, 2, 4, 8):
            h = h[:-width] * U(step) + h[width:]
            step = step * step % (1 << 64)
        at = np.nonzero((mix(h) & self.mask) == 0)[0] + 16
        at = at[at < n]
        at = at[(raw[at] & 0xC0) != 0x80]  # never within a character
        row = np.searchsorted(offsets, at, "right") - 1
        return np.unique(np.concatenate([at[at - 16 >= offsets[row]], offsets]))

    def chunk(self, chunk: str) -> tuple[bytes, str | None, str]:
        """(ids between the first and the last safe place, text before them or None without a safe place, text after)."""
        if (known := self.chunks.get(chunk)) is None:
            if place := _SAFE.search(chunk):
                first, last = place.start(), _LAST_SAFE.match(chunk).end()
                known = self.ids(chunk[first:last]), chunk[:first], chunk[last:]
            else:
                known = b"", None, chunk
            self.chunks[chunk] = known
            self.held += 2 * len(chunk) + len(known[0]) + 400
        return known

    def join(self, window: str) -> bytes:
        if (known := self.joins.get(window)) is None:
            known = self.joins[window] = self.ids(window)
            self.held += 6 * len(window) + 300
        return known

    def encode_rows(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column."""
        raw, offsets = text_view(column)
        data, cuts = raw.tobytes(), self.cut(raw, offsets)
        first = np.searchsorted(cuts, offsets)
        for row in range(len(column)):
            out: list[bytes] = []
            open_: list[str] = []  # the window around the join at hand
            for i in range(first[row], first[row + 1]):
                end = cuts[i + 1] if i + 1 < len(cuts) else len(data)
                inner, before, after = self.chunk(data[cuts[i] : end].decode())
                if before is None:
                    open_.append(after)
                else:
                    open_.append(before)
                    out += self.join("".join(open_)), inner
                    open_ = [after]
            if open_:
                out.append(self.join("".join(open_)))
            yield b"".join(out)
            if self.held > self.cache_bytes:
                self.chunks, self.joins, self.held = {}, {}, 0

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, as do ids without a token."""
        return b"".join([self.bytes_of.get(i, b"\xef\xbf\xbd") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def codec_maker(spark: SparkSession, path: str | None = None, **options):
    """A function for tasks that makes the codec once per worker. The vocabulary (its size is fixed, some MB) is broadcast."""
    handle = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))
    kept: list[Codec] = []

    def make() -> Codec:
        if not kept:
            kept.append(Codec(*handle.value, **options))
        return kept[0]

    return make


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, out: str = "ids", decoded: str | None = None, **options) -> DataFrame:
    """All columns of docs inside ``row``, and the ids of the whole text as little-endian 32-bit numbers (BINARY).

    decoded: also name a column for the text that the ids decode to. Null counts as empty, which has no ids; texts of
    any length are encoded whole; strings of special tokens in a text become these tokens; repeated rows are encoded
    alike. Names of columns inside ``row`` don't matter.
    """
    from pyspark.sql import functions as F

    make = codec_maker(docs.sparkSession, path, **options)
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for block in blocks(batches, "text"):
            ids = list(codec.encode_rows(block.column("text")))
            columns, names = [block.column("row"), pa.array(ids, pa.binary())], ["row", out]
            if decoded:
                columns, names = [*columns, pa.array([codec.decode(x) for x in ids], pa.string())], [*names, decoded]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = f"row {rows.schema['row'].dataType.simpleString()}, {out} binary" + (f", {decoded} string" if decoded else "")
    return rows.mapInArrow(run, kind)


def decode(df: DataFrame, *, ids: str = "ids", out: str = "decoded", path: str | None = None, **options) -> DataFrame:
    """All columns of df inside ``row``, and the text of its ids; null counts as no ids."""
    from pyspark.sql import functions as F

    make = codec_maker(df.sparkSession, path, **options)
    bounded_arrow(df.sparkSession)
    rows = df.select(F.struct("*").alias("row"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for block in blocks(batches, "ids"):
            texts = [codec.decode(x or b"") for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(texts, pa.string())], ["row", out])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {out} string")
