"""Token counts by a separator scan over flat token blocks.

``write_tokens`` turns documents into flat shards: 16-bit token ids, an end-of-document id behind each document, cut
into blocks of a fixed number of tokens wherever that falls; no index of documents' starts is kept. ``scan_tokens``
finds the separators of every block with numpy, and stitches documents that go on over blocks: a prefix scan over a
shard's blocks (window functions) gives each block the tokens, the documents and the last separator before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batches import bounded_arrow, blocks
from .bpe import codec_maker

#: Tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Documents named by one row of the shard's list.
LISTED = 4096
SEPARATOR = "<|endoftext|>"
#: Stands for a missing key in the shards' lists.
NO_KEY = -(1 << 63)

_FLAT = "shard int, kind string, seq long, data binary"


def write_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token shards, one for each partition: rows (shard, kind, seq, data).

    kind ``tokens``: block number seq of the shard, little-endian 16-bit ids. kind ``docs``: the 64-bit keys of the
    shard's documents in order, from document number seq on. Null and empty texts are a separator alone; the
    separator's own string inside a text is encoded as ordinary text, so that it can't split a document. Texts of any
    length go over as many blocks as they need; repeated rows are documents of their own; a missing key stays missing.
    The partition number names the shard: store the result (one job makes both kinds) before reading it twice.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    make = codec_maker(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard = make(), TaskContext.get().partitionId()
        kept = np.zeros(0, "<u2")
        parts, size, block, keys, listed = [kept], 0, 0, [], 0
        if codec.plain.max_token_value > 0xFFFF:
            raise ValueError("the vocabulary has more ids than 16 bits hold")
        end = np.full(1, codec.plain._special_tokens[SEPARATOR], "<u2")

        def rows(kind: str, seqs: list[int], data: list[bytes]) -> pa.RecordBatch:
            n = len(seqs)
            return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([kind] * n), pa.array(seqs, pa.int64()), pa.array(data, pa.binary())], ["shard", "kind", "seq", "data"])

        for batch in blocks(batches, "text"):
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = codec.plain.encode_to_numpy(value or "", disallowed_special=())
                parts += ids.astype("<u2"), end
                size += len(ids) + 1
                keys.append(name)
                if size >= block_tokens:
                    flat = np.concatenate(parts)
                    whole = size // block_tokens
                    yield rows("tokens", list(range(block, block + whole)), [flat[i * block_tokens : (i + 1) * block_tokens].tobytes() for i in range(whole)])
                    block, parts, size = block + whole, [flat[whole * block_tokens :]], size - whole * block_tokens
                if len(keys) >= LISTED:
                    yield rows("docs", [listed], [np.array(keys, "<i8").tobytes()])
                    listed, keys = listed + len(keys), []
        if size:
            yield rows("tokens", [block], [np.concatenate(parts).tobytes()])
        if keys:
            yield rows("docs", [listed], [np.array(keys, "<i8").tobytes()])

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text")).mapInArrow(run, _FLAT)


def _separators(flat: DataFrame, separator: int) -> DataFrame:
    """(shard, seq, n_tokens, ends): the separators' places in each block, packed as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), "<u2") if data.is_valid else np.zeros(0, "<u2")
                sizes.append(len(ids))
                ends.append(np.nonzero(ids == separator)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("seq"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["shard", "seq", "n_tokens", "ends"])

    return flat.where("kind = 'tokens'").select("shard", "seq", "data").mapInArrow(run, "shard int, seq long, n_tokens long, ends array<bigint>")


def scan_tokens(flat: DataFrame, separator: int) -> DataFrame:
    """(shard, document, n_tokens): tokens of each document of each shard, by its number from 0 on; separators don't count.

    Tokens behind a shard's last separator are no document. An empty table has none.
    """
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        _separators(flat, separator)
        .withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("first_doc", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
        .withColumn("last_before", F.coalesce(F.max("last_end").over(before), F.lit(-1)))
    )
    return placed.select("shard", "first_doc", "last_before", "start", F.posexplode("ends").alias("i", "end"), "ends").select(
        "shard",
        (F.col("first_doc") + F.col("i")).alias("document"),
        (F.col("start") + F.col("end") - F.when(F.col("i") == 0, F.col("last_before")).otherwise(F.col("start") + F.expr("ends[greatest(i - 1, 0)]")) - 1).alias("n_tokens"),
    )


def document_keys(flat: DataFrame) -> DataFrame:
    """(shard, document, doc_id) from the shards' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "data")), strict=True):
                keys = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), pa.array(seq + np.arange(len(keys))), pa.array(keys)], ["shard", "document", "doc_id"])

    return flat.where("kind = 'docs'").select("shard", "seq", "data").mapInArrow(run, "shard int, document long, doc_id long").withColumn("doc_id", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")))
