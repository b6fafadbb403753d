"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language on a bounded sample of labelled rows; the log-probability matrix (its
size is fixed by the parameters) is broadcast. Scoring takes whole texts: numpy hashes every n-gram of a block of
texts, reduces them to sparse (text, bucket, count) rows and multiplies these with the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import U, bounded_arrow, blocks, mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: At most so many rows are learned from for each language, those of the smallest hash of their key and text.
TRAIN_ROWS = 4000
#: Bytes of text whose n-grams are made at once: their arrays take over a hundred times as much.
AT_ONCE = 1 << 19
SMOOTHING = 0.5
UNDETERMINED = "und"


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lower-cased texts, a space before each and after the last; first places and the end)."""
    texts = [(x or "").lower() for x in column.to_pylist()]
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def features(column: pa.Array, letters: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of words with their borders, and which rows have a letter.

    Code points that aren't letters count as one space; n-grams with a space inside (not at an end) are left out.
    """
    codes, at = _codes(column)
    is_letter = letters[codes]
    plain = np.where(is_letter, codes, 32).astype(U)
    n, rows = len(codes), len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(at))
    owner = np.concatenate([owner, np.full(n - len(owner), rows - 1)])
    keys = []
    for order in orders:
        if n < order:
            continue
        h = np.full(n - order + 1, order, U)
        for i in range(order):
            h = h * U(0x9E3779B97F4A7C15) + plain[i : n - order + 1 + i]
        if order == 1:
            keep = is_letter
        elif order == 2:
            keep = is_letter[:-1] | is_letter[1:]
        else:
            keep = np.ones(n - order + 1, bool)
            for i in range(1, order - 1):
                keep &= is_letter[i : n - order + 1 + i]
        place = np.nonzero(keep)[0]
        # an n-gram that begins with the space before a text belongs to that text
        keys.append(owner[place] * buckets + (mix(h[place]) % U(buckets)).astype(np.int64))
    has = np.zeros(rows, bool)
    has[owner[is_letter]] = True
    key = np.concatenate(keys)
    if rows * buckets <= 1 << 22:
        counts = np.bincount(key, minlength=0)
        key = np.nonzero(counts)[0]
        count = counts[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return key // buckets, key % buckets, count, has


def _counted(batches: Iterator[pa.RecordBatch], orders=ORDERS, buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): n-grams of each language among rows (lang, text); bucket -1 has its documents."""
    letters = _letters()
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for block in blocks(batches, "text", AT_ONCE):
        row, bucket, n, _ = features(block.column("text"), letters, orders, buckets)
        names = np.array(block.column("lang").to_pylist(), object)
        for name in set(names.tolist()):
            mine = (names == name)[row]
            total[name] = total.get(name, 0) + np.bincount(bucket[mine], n[mine], buckets)
            docs[name] = docs.get(name, 0) + int((names == name).sum())
    for name, counts in total.items():
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs[name]))], ["lang", "bucket", "n"])


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # BUCKETS x languages
    orders: tuple[int, ...] = ORDERS


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", order_by: str | None = None, train_rows: int = TRAIN_ROWS, orders=ORDERS, buckets: int = BUCKETS) -> Model:
    """Learn from rows with a text and a language: of each language at most train_rows rows (by a hash, at random but fixed).

    Counting runs on the executors; the driver gets (language, bucket, count) sums, whose number the parameters bound.
    Without any labelled row the model has no language and all texts are undetermined.
    """
    from pyspark.sql import Window

    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(*([F.col(order_by)] if order_by else []), F.col(text)).alias("h"))
    bounded_arrow(rows.sparkSession)
    # the cut-off keeps about train_rows of each language, without a global sort
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((buckets, 0)), tuple(orders))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_rows / n))).otherwise(share)
    sample = labelled.where(F.pmod(F.col("h"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, orders, buckets)

    sums = sample.mapInArrow(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    table = np.full((buckets, len(names)), SMOOTHING)
    for i, name in enumerate(names):
        own = sums[(sums["lang"] == name) & (sums["bucket"] >= 0)]
        table[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    prior = np.array([sizes[name] for name in names], float)
    return Model(names, np.log(prior / prior.sum()), np.log(table / table.sum(0)), tuple(orders))


def language_model(docs: DataFrame) -> Model:
    """Learned from the documents (doc_id, text, lang) that aren't held out: one fold of four of their ids' CRC is."""
    return train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), order_by="doc_id")


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of docs inside ``row``; lang_pred and score, the probability of that language under the model.

    ``und`` with score 0 where the text is null or has no letter, or the model has no language. Repeated rows get the
    same prediction; nothing but the text is looked at.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = handle.value, _letters()
        buckets, k = model.log_prob.shape
        names = np.array([*model.languages, UNDETERMINED], object)
        for block in blocks(batches, "text", AT_ONCE):
            row, bucket, n, has = features(block.column("text"), letters, model.orders, buckets)
            size = block.num_rows
            if k:
                score = np.stack([np.bincount(row, n * model.log_prob[bucket, i], size) for i in range(k)], 1) + model.log_prior
                best = score.argmax(1)
                chance = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
            else:
                best, chance, has = np.zeros(size, int), np.zeros(size), np.zeros(size, bool)
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(pd.Series(names[np.where(has, best, k)])), pa.array(np.where(has, chance, 0.0))], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, *, text: str = "text", lang: str | None = None) -> DataFrame:
    """The documents whose language can be told, with their own columns; those without any letter are rejected.

    lang: a column whose missing values are filled with the prediction.
    """
    found = predict(docs, model, text=text).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.coalesce(f"row.`{c}`", "lang_pred").alias(c) if c == lang else F.col(f"row.`{c}`") for c in docs.columns])
