"""A training corpus from ``documents``, in stages. Each stage works on the whole table that the stage before it wrote.
Columns beside those of documents are left out, so that no name can clash; an empty table gives an empty one.

Every function takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage's result is to be
written before the next stage begins: that one deletes the intermediate tables of the one before.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestate.llm import bpe, decontam, langid, minhash, suffix_dedup
from lodestate.llm.langid import language_model
from lodestate.sources.shared import discard, stored, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT = threading.local()


def _stage(make: Stage) -> Stage:
    """The stage, with the tables deleted that the stage before has left behind in this thread."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, getattr(_LEFT, "paths", []))
        before = len(written())
        out = make(spark, docs, sf_dir)
        _LEFT.paths = written()[before:]
        return out

    return run


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without any letter go, missing languages are filled in. A null text has no letter; repeated rows stay."""
    return langid.keep_identified(docs.select(*COLUMNS), language_model(docs), lang="lang")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash: the document of the smallest id stays of each group. Documents of Jaccard 0.8 and up are near duplicates.

    Rows of one id stay or go together; rows without an id or without words stay.
    """
    return minhash.keep_one(docs.select(*COLUMNS), percent=80)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: passages that an earlier document has are cut out of the texts. Halves of cut characters go too.

    Every row stays; a null text becomes an empty one, a null id counts as the last.
    """
    left = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    return left.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.char_length("kept").cast("long").alias("n_chars"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays over words: documents with a benchmark window go. Texts without words stay."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids of the texts that are left, and whether they decode to the same text."""
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), decoded="decoded")
    return coded.select("row.doc_id", "row.lang", "row.source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("exact"), "ids")


STAGES = [
    ("language ID", identify),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("BPE", encode),
]

#: The rows of run() as DuckDB SQL: trained, iterative and byte-wise stages have none; a test holds run() against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
