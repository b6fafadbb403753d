"""Benchmark decontamination with training suffix arrays.

Each block of training documents gets a (sparse) suffix array over its words: the suffixes that begin with the
first words of some benchmark window, in the order of their first WINDOW words. Every benchmark window (a test
suffix cut at WINDOW words) that begins like one of these is then binary-searched in the block's array; the range it
finds holds all verbatim matches with their locations. Words are symbols, one for each different word, not hashes.
Joined locations are the longest verbatim matches, and documents with any are
affected. The suffixes left out begin with words that no benchmark window begins with, so no search can end on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import LOWER, bounded_arrow, blocks, stored, text_view, total_bytes, word_numbers, word_spans

#: Words of a benchmark window.
WINDOW = 10
#: A suffix enters the array if its first HEAD words (fewer for shorter windows) begin a window.
HEAD = 4
#: Benchmark text that is held in memory and broadcast at once; larger benchmarks go through in several passes.
BENCHMARK_BLOCK_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(word numbers, which words are long, these words, row of each word) of lower-cased texts."""
    low = LOWER[raw]
    starts, ends, rows = word_spans(_WORD[low], offsets)
    return *word_numbers(low, starts, ends), rows


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _head_keys(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A key for the n word numbers from each place on (places must have n words)."""
    key = np.zeros(len(at), np.uint64)
    for i in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[at + i].astype(np.uint64) + np.uint64(1)
    return key


@dataclass
class TestSuffixes:
    """Distinct benchmark windows as sorted rows of word numbers (0 beyond a window's end), with their items."""

    vocabulary: np.ndarray  # sorted numbers of short words; such a word's symbol is its index + 1
    long_words: dict[bytes, int]  # symbols of the long ones
    windows: np.ndarray  # m x WINDOW
    lengths: np.ndarray  # m
    item_start: np.ndarray  # m + 1, into items
    items: np.ndarray  # indices into item_ids
    item_ids: list[str]
    heads: dict[int, tuple[np.ndarray, np.ndarray]]  # by the number of first words: their sorted keys, the windows in that order

    def symbols(self, numbers: np.ndarray, long_: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The words' symbols, 0 for those that the benchmark doesn't have. Words are compared as they are, not by a hash."""
        out = _lookup(self.vocabulary, numbers) + 1
        out[long_] = [self.long_words.get(w, 0) for w in words]
        return out

    @classmethod
    def build(cls, item_ids: list[str], texts: list[str | None], window: int = WINDOW) -> TestSuffixes:
        raw, offsets = text_view(pa.array(texts, pa.string()))
        numbers, long_, words, rows = _words(raw, offsets)
        short = np.ones(len(numbers), bool)
        short[long_] = False
        vocabulary = np.unique(numbers[short])
        long_words = {w: len(vocabulary) + 1 + i for i, w in enumerate(sorted(set(words)))}
        number = np.searchsorted(vocabulary, numbers) + 1
        number[long_] = [long_words[w] for w in words]
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        found, owner = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                padded = np.concatenate([number[a:b], np.zeros(max(0, window - (b - a)), number.dtype)])
                view = np.lib.stride_tricks.sliding_window_view(padded, window)
                found.append(view)
                owner.append(np.full(len(view), i))
        if not found:
            empty = np.zeros(0, np.int64)
            return cls(vocabulary, long_words, np.zeros((0, window), np.int64), empty, np.zeros(1, np.int64), empty, item_ids, {})
        windows, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)], 1), axis=0)
        lengths = (windows > 0).sum(1)
        heads = {}
        for n in range(1, HEAD + 1):
            own = np.nonzero(lengths == n if n < HEAD else lengths >= n)[0]
            if len(own):
                keys = _head_keys(windows.reshape(-1), own * window, n)
                order = np.argsort(keys, kind="stable")
                heads[n] = keys[order], own[order]
        return cls(vocabulary, long_words, windows, lengths, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1], item_ids, heads)


def suffix_array(words: np.ndarray, rows: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in suffix order, their first words, the test suffixes to search for).

    The array has the suffixes of training words that begin like some test suffix; test suffixes that begin like none of
    them have no match here and need no search.
    """
    n, width = len(words), test.windows.shape[1]
    keep = np.zeros(n, bool)
    asked = [np.zeros(0, np.int64)]
    for head, (keys, windows) in test.heads.items():
        if n < head:
            continue
        whole = words > 0
        start = whole[: n - head + 1].copy()
        for i in range(1, head):
            start &= whole[i : n - head + 1 + i]
        start &= rows[: n - head + 1] == rows[head - 1 :]
        at = np.nonzero(start)[0]
        own = _head_keys(words, at, head)
        found = _lookup(keys, own) >= 0
        keep[at[found]] = True
        present = np.unique(own[found])
        low, high = np.searchsorted(keys, present, "left"), np.searchsorted(keys, present, "right")
        asked.append(windows[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())])
    places = np.nonzero(keep)[0]
    padded = np.concatenate([words, np.zeros(width, words.dtype)])
    ends = np.searchsorted(rows, rows[places], "right")
    column = places[:, None] + np.arange(width)
    first = np.where(column < ends[:, None], padded[column], 0)
    order = np.lexsort(first.T[::-1])
    return places[order], first[order], np.concatenate(asked)


def _bound(array: np.ndarray, queries: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all queries at once: the first suffix that isn't below (upper: that is above) the query's words."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(array), np.int64)
    inside = np.arange(queries.shape[1]) < lengths[:, None]
    while (open_ := np.nonzero(low < high)[0]).size:
        middle = (low[open_] + high[open_]) // 2
        difference = np.where(inside[open_], array[middle] - queries[open_], 0)
        where = (difference != 0).argmax(1)
        sign = difference[np.arange(len(open_)), where]
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


def _search(block: pa.RecordBatch, test: TestSuffixes) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """(words of each document, its hit word ranges, ids of the items found in it)."""
    raw, offsets = text_view(block.column("text"))
    n = block.num_rows
    numbers, long_, long_words, rows = _words(raw, offsets)
    first = np.searchsorted(rows, np.arange(n + 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if len(test.windows) and len(numbers):
        words = test.symbols(numbers, long_, long_words)
        places, array, asked = suffix_array(words, rows, test)
        low, high = (_bound(array, test.windows[asked], test.lengths[asked], upper) for upper in (False, True))
        found = np.nonzero(high > low)[0]
        if len(found):
            count = high[found] - low[found]
            match = np.repeat(asked[found], count)
            at = places[np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + test.lengths[match], -1)
            starts, ends, owner = word_spans(np.cumsum(edge[:-1]) > 0, first)
            for s, e, r in zip(starts, ends, owner, strict=True):
                spans[r].append((int(s - first[r]), int(e - first[r])))
            pairs = np.unique(np.stack([rows[at], match], 1), axis=0)
            each = test.item_start[pairs[:, 1] + 1] - test.item_start[pairs[:, 1]]
            of = test.items[np.repeat(test.item_start[pairs[:, 1]] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            for r, i in np.unique(np.stack([np.repeat(pairs[:, 0], each), of], 1), axis=0):
                items[r].append(test.item_ids[i])
    return np.diff(first), spans, items


def _merged_length() -> Column:
    """Words in the union of the column ``spans``."""
    return F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'e', -1), (a, x) -> named_struct("
        "'n', a.n + greatest(0, x.e - greatest(x.s, a.e)), 'e', greatest(a.e, x.e)), a -> a.n)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """Matches of benchmark windows in every document: its row as struct ``row``, n_words, n_hit, spans, item_ids.

    Null and empty texts have no words and no hits; items without words have no windows; repeated items and repeated
    documents each count for themselves (items of one id count once). Spans are half-open word ranges: the longest
    verbatim matches, joined where they overlap. Columns of docs may have any names, as they stay inside ``row``.
    The benchmark is broadcast in parts of at most block_bytes of text, one pass over the documents for each part.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    _, size = total_bytes(benchmark, item_text)
    parts = max(1, -(-size // block_bytes))
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("item_text")).distinct()
    state = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    for part in range(parts):
        mine = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(parts)) == part)
        rows = mine.toPandas()
        handle = spark.sparkContext.broadcast(TestSuffixes.build(rows["item"].tolist(), [x if isinstance(x, str) else None for x in rows["item_text"]], window))

        def run(batches, handle=handle):
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            for block in blocks(batches, "text"):
                words, spans, items = _search(block, handle.value)
                before, known = block.column("spans").to_pylist(), block.column("item_ids").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [block.column("row"), block.column("text"), pa.array(words, pa.int64()), pa.array([[*a, *({"s": s, "e": e} for s, e in b)] for a, b in zip(before, spans, strict=True)], kind), pa.array([[*a, *b] for a, b in zip(known, items, strict=True)], pa.list_(pa.string()))],
                    ["row", "text", "n_words", "spans", "item_ids"],
                )

        state = state.mapInArrow(run, state.schema)
        if part + 1 < parts:
            state = stored(state, "decontam")
    return state.select("row", "n_words", _merged_length().alias("n_hit"), "spans", F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return contamination(docs, benchmark, **options).where("n_hit = 0").select("row.*")
