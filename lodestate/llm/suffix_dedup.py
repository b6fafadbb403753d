"""Removal of passages that an earlier document already has, by suffix arrays.

A passage is a string of MATCH bytes. Each one holds an anchor: the ANCHOR bytes of the smallest rolling hash in it
(content alone decides which), with at most REACH bytes of the passage on either side. So:

1. Every text gives its anchors, each with a 96-bit keyed digest of its whole context (the anchor and REACH bytes
   around it). Of equal contexts in one block of texts, only the smallest document's is sent on: the others are repeats
   whatever else there is. The rest is dealt by the anchor's hash as packed columns.
2. An anchor that occurs in one document only is dropped. If a smaller document has the same context, all passages in
   it are repeats. What is left is the first context of each kind among several kinds with one anchor: at the
   borders of repeats.
3. These contexts are fetched from the texts and dealt by anchor. For each part, two suffix arrays (of the bytes behind
   the anchors, and of the bytes before them backwards, read in blocks of eight bytes) bring equal passages together;
   common prefixes of neighbours give the passages' classes, and each class its smallest document. An anchor with very
   many contexts isn't one task's work: its passages are grouped by their bytes instead.
4. Repeated passages are cut out of the texts.

The suffix arrays are built by the linear grouping of ``lyndon``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import BYTE_KEY, STEP, U, blocks, bounded_arrow, mix, stored, text_view, total_bytes
from .lyndon import suffix_array

#: Bytes of a passage; of its anchor; and how far a passage reaches on either side of its anchor.
MATCH, ANCHOR = 50, 26
REACH = MATCH - ANCHOR
#: Text of one pass over anchors.
ANCHOR_BLOCK = 3 << 20
#: Contexts of one pair of suffix arrays, about.
PART = 20_000
#: An anchor of more than one context for so many bytes of text (and of more than PART in any case) has its passages grouped by Spark.
HOT_BYTES = 200_000
#: Bytes of text whose anchors one bucket holds at once (some six times as many bytes of columns), about.
BUCKET_TEXT = 48 << 20
#: Anchors of one hash that a bucket may get from all blocks. Where a block alone has more contexts of one anchor than its
#: share, these are dealt by their digests instead.
BUCKET_ROWS = 2_000_000


def rolling(raw: np.ndarray, width: int = ANCHOR) -> np.ndarray:
    """Hash of the width bytes from each place on, put together from ranges of 1, 2, 4, ... bytes."""
    n = len(raw) - width + 1
    h, step, size, taken, out = BYTE_KEY[raw], 0x9E3779B97F4A7C15, 1, 0, np.zeros(n, U)
    while taken < width:
        if width & size:
            out = out * U(step) + h[taken : taken + n]
            taken += size
        h, step, size = h[:-size] * U(step) + h[size:], step * step % (1 << 64), 2 * size
    return mix(out)


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each width neighbours."""
    choose, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        values = choose(values[:-step], values[step:])
        done += step
    return values


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts of at least MATCH bytes. Texts are told apart by their borders.

    A place is chosen if its hash is the smallest of all places in some passage; equal smallest ones are all chosen.
    """
    if len(raw) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = rolling(raw)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    width = REACH + 1
    low = _slide(h, width, True)  # of the passage that begins here
    inside = row[: len(low)] == row[MATCH - 1 :]
    low[~inside] = 0
    edge = np.zeros(width - 1, U)
    best = _slide(np.concatenate([edge, low, edge]), width, False)
    at = np.nonzero((best == h) & (h > 0))[0]
    at = at[row[at] == row[at + ANCHOR - 1]]
    at = at[_needed(at, h[at])]
    return at, h[at]


def _needed(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which anchors are needed: in periodic text (one hash again and again at one small distance) not all are.

    Those near the ends of a period's run stand for every passage there is in it; further inside, each passage needs
    just one anchor of its own.
    """
    n = len(at)
    if n < 3:
        return np.ones(n, bool)
    gap = np.diff(at)
    same = (h[1:] == h[:-1]) & (gap <= REACH)
    inner = np.zeros(n, bool)
    inner[1:-1] = same[1:] & same[:-1] & (gap[1:] == gap[:-1])
    if not inner.any():
        return np.ones(n, bool)
    place = np.arange(n)
    first = at[np.maximum.accumulate(np.where(inner, 0, place))]
    last = at[np.minimum.accumulate(np.where(inner, n - 1, place)[::-1])[::-1]]
    step = np.append(gap, 1)
    edge = REACH + 1 + step
    spread = ((at - first) // step) % np.maximum(1, (REACH + 1) // step) == 0
    return ~inner | (at - first < edge) | (last - at < edge) | spread


def _context_bounds(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.searchsorted(offsets, at, "right") - 1
    return row, np.maximum(offsets[row], at - REACH), np.minimum(offsets[row + 1], at + ANCHOR + REACH)


#: Bytes of a context and its two lengths, in 32-bit numbers.
_WIDTH = (ANCHOR + 2 * REACH + 5) // 4
#: Multilinear hashes that make up a digest, and their keys.
_HASHES = 3
_KEYS = mix(np.arange(1, _HASHES * (_WIDTH + 1) + 1, dtype=U) * STEP).reshape(_WIDTH + 1, _HASHES)


def context_digests(raw: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests, as 64 and 32 bits, of the contexts raw[left:right] around the anchors at.

    Three multilinear hashes (a key for each 32 bits and each place, the upper half of the sum): two different contexts
    agree in one of them with a chance of 2**-32, and in all with 2**-96.
    """
    size = ANCHOR + 2 * REACH
    padded = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(4 * _WIDTH, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 4 * _WIDTH)
    out = np.empty((len(at), _HASHES), U)
    for i in range(0, len(at), 1 << 15):
        own = slice(i, i + (1 << 15))
        before, behind = at[own] - left[own], right[own] - at[own] - ANCHOR
        rows = windows[at[own]]
        cut = np.nonzero((before < REACH) | (behind < REACH))[0]
        if len(cut):
            place = np.arange(4 * _WIDTH)
            rows[cut] = np.where((place >= REACH - before[cut, None]) & (place < REACH + ANCHOR + behind[cut, None]), rows[cut], 0)
        rows[:, size], rows[:, size + 1], rows[:, size + 2 :] = before, behind, 0
        out[own] = (rows.view("<u4").astype(U) @ _KEYS[:-1] + _KEYS[-1]) >> U(32)
    return out[:, 0] << U(32) | out[:, 1], out[:, 2].astype(np.uint32)


def _packed(values: np.ndarray, width: int | None = None) -> bytes:
    """Non-negative integers of so many bytes (as few as they need, named in front, without width), one plane behind the other."""
    head = b""
    if width is None:
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
        head = bytes([width])
    return head + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes, width: int | None = None) -> np.ndarray:
    if width is None:
        width, data = data[0], data[1:]
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


#: kind: ANCHORS in columns; LOCAL: places that are repeats already. counts: anchors of each document; base: the least document.
_ANCHORS = "bucket int, kind int, h binary, c binary, at binary, base long, docs binary, marks binary, counts binary"
ANCHORS, BEACON, BY_DIGEST, LOCAL = 0, 1, 2, 3


def _bucket_names(spark: SparkSession, partitions: int) -> list[int]:
    """For each hash partition a number that repartition(partitions, column) deals to it, so that each gets one bucket."""
    rows = spark.range(24 * partitions).select(F.col("id").cast("int").alias("name")).withColumn("p", F.pmod(F.hash("name"), F.lit(partitions)))
    found = {r.p: r.name for r in rows.groupBy("p").agg(F.min("name").alias("name")).collect()}
    return [found.get(p, 24 * partitions + p) for p in range(partitions)]


def _anchor_rows(texts: DataFrame, names: list[int], crowd: int) -> DataFrame:
    """Anchors in packed columns: for each block of texts and bucket one row of each kind.

    crowd: contexts of one anchor in one block from which on they are dealt by their digests; its hash's bucket is told so
    by a BEACON, as contexts of the same anchor from other blocks may lie there.
    """
    buckets = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", ANCHOR_BLOCK):
            raw, offsets = text_view(block.column("text"))
            at, h = anchors(raw, offsets)
            if not len(at):
                continue
            row, left, right = _context_bounds(at, offsets)
            c, c2 = context_digests(raw, at, left, right)
            docs, marks = (np.array(block.column(x)) for x in ("doc", "mark"))
            place, doc = at - offsets[row], docs[row]
            # of equal contexts in this block, the smallest document's are sent on
            order = np.lexsort((doc, c2, c))
            kind = np.ones(len(order), bool)
            kind[1:] = (c[order[1:]] != c[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])
            least = np.empty(len(order), np.int64)
            least[order] = doc[order][np.nonzero(kind)[0]][np.cumsum(kind) - 1]
            local = doc > least
            of_hash, inverse = np.unique(h, return_inverse=True)
            contexts = np.bincount(inverse, np.bincount(order[kind], minlength=len(h)), len(of_hash))
            crowded = (contexts > crowd)[inverse]
            kinds = np.where(local, LOCAL, np.where(crowded, BY_DIGEST, ANCHORS))
            bucket = (np.where(kinds == ANCHORS, h, np.where(kinds == LOCAL, mix(doc.astype(U)), c)) % U(buckets)).astype(np.int64)
            out: list[tuple] = []
            order = np.lexsort((row, bucket, kinds))  # stable: places of a document stay in order
            key = kinds[order] * buckets + bucket[order]
            bounds = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key))
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = order[first:last]
                rows, counts = np.unique(row[own], return_counts=True)
                base, k = int(docs[rows].min()), int(kinds[own[0]])
                who = base, _packed(docs[rows].astype(U) - np.array(base).astype(U)), marks[rows].astype("<i4").tobytes(), _packed(counts)
                what = (None, None) if k == LOCAL else ((h[own] >> U(32)).astype("<u4").tobytes(), c[own].astype("<u8").tobytes() + c2[own].astype("<u4").tobytes())
                out.append((names[bucket[own[0]]], k, *what, _packed(place[own]), *who))
            if crowded.any():
                beacons = np.unique(h[crowded])
                deal = (beacons % U(buckets)).astype(np.int64)
                for b in np.unique(deal):
                    out.append((names[b], BEACON, (beacons[deal == b] >> U(32)).astype("<u4").tobytes(), None, None, 0, None, None, None))
            kinds_ = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds_, strict=True)], [x.split()[0] for x in _ANCHORS.split(", ")])

    return texts.select("doc", "mark", "text").mapInArrow(run, _ANCHORS)


_FOUND = "doc long, mark long, kind int, data binary"
REPEAT, OPEN, CROWDED, SPANS, TEXT = 1, 2, 3, 4, 9


def _marks(doc: np.ndarray, mark: np.ndarray, kind: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Places by document and kind."""
    order = np.lexsort((at, kind, mark, doc))
    doc, mark, kind, at = doc[order], mark[order], kind[order], at[order]
    first = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (kind[1:] != kind[:-1])]))[0]
    places = at.astype("<u4").tobytes()
    ends = np.append(first[1:], len(at)) * 4
    data = [places[a:b] for a, b in zip((first * 4).tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(mark[first]), pa.array(kind[first], pa.int32()), pa.array(data, pa.binary())], ["doc", "mark", "kind", "data"])


def _judge(h: np.ndarray, c: np.ndarray, c2: np.ndarray, doc: np.ndarray, mark: np.ndarray, at: np.ndarray, known: np.ndarray | None, hot: int) -> pa.RecordBatch | None:
    """Of one bucket's anchors: places whose whole context is a repeat, and the first contexts of each kind where kinds differ.

    known: hashes of anchors that are known to have many contexts in other buckets, too; None: all are.
    """
    order = np.lexsort((doc, c2, c, h))
    h, c, c2, doc, mark, at = h[order], c[order], c2[order], doc[order], mark[order], at[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])])
    first_h, kind = np.nonzero(new_h)[0], np.cumsum(new_c) - 1
    low, high = np.minimum.reduceat(doc, first_h), np.maximum.reduceat(doc, first_h)
    anchor = np.cumsum(new_h) - 1
    kinds = np.add.reduceat(new_c.astype(np.int64), first_h)
    elsewhere = np.ones(len(first_h), bool) if known is None else np.isin(h[first_h], known)
    repeat = doc > doc[np.nonzero(new_c)[0]][kind]
    open_ = ~repeat & (elsewhere | ((low < high) & (kinds > 1)))[anchor]
    chosen = np.nonzero(repeat | open_)[0]
    if not len(chosen):
        return None
    crowded = (elsewhere | (kinds > hot))[anchor[chosen]]
    return _marks(doc[chosen], mark[chosen], np.where(repeat[chosen], REPEAT, np.where(crowded, CROWDED, OPEN)), at[chosen])


def _find(rows: DataFrame, partitions: int, hot: int) -> DataFrame:
    """Judged anchors, bucket by bucket: (document, text hash, kind, packed places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        beacons: list[np.ndarray] = []
        at_hand = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                known = None if at_hand[1] == BY_DIGEST else np.concatenate(beacons) if beacons else np.zeros(0, np.uint32)
                found = _judge(*(np.concatenate(x) for x in zip(*held, strict=True)), known, hot)
                held.clear()
                if found is not None:
                    yield found

        for batch in batches:
            for i, (bucket, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                own = bucket, BY_DIGEST if kind == BY_DIGEST else ANCHORS
                if own != at_hand and kind != LOCAL:
                    yield from close()
                    if at_hand is not None and at_hand[0] != bucket:
                        beacons.clear()
                    at_hand = own
                h, c, at, docs, marks, counts = (batch.column(x)[i].as_py() for x in ("h", "c", "at", "docs", "marks", "counts"))
                if kind == BEACON:
                    beacons.append(np.frombuffer(h, "<u4"))
                    continue
                doc = (_unpacked(docs) + np.array(batch.column("base")[i].as_py()).astype(U)).astype(np.int64)
                times = _unpacked(counts).astype(np.int64)
                who = np.repeat(doc, times), np.repeat(np.frombuffer(marks, "<i4").astype(np.int64), times), _unpacked(at).astype(np.int64)
                if kind == LOCAL:
                    yield _marks(who[0], who[1], np.full(len(who[0]), REPEAT), who[2])
                else:
                    n = len(h) // 4
                    held.append((np.frombuffer(h, "<u4"), np.frombuffer(c, "<u8", n), np.frombuffer(c, "<u4", n, 8 * n), *who))
        yield from close()

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, _FOUND)


def _by_document(texts: DataFrame, marks: DataFrame, partitions: int) -> DataFrame:
    """Marks and texts (compressed) of each document in one shuffle; a document's texts come behind its marks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for block in blocks(batches, "text"):
            data = [squeeze.compress((x or "").encode()) for x in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc"), block.column("mark"), pa.array([TEXT] * block.num_rows, pa.int32()), pa.array(data, pa.binary()), block.column("row")], ["doc", "mark", "kind", "data", "row"])

    kind = f"doc long, mark long, kind int, data binary, row {texts.schema['row'].dataType.simpleString()}"
    whole = texts.select("doc", "mark", "text", "row").mapInArrow(pack, kind).unionByName(marks.select("doc", "mark", "kind", "data", F.lit(None).cast(texts.schema["row"].dataType).alias("row")))
    return whole.repartition(partitions, "doc", "mark").sortWithinPartitions("doc", "mark", "kind")


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted, joined (start, end) ranges within 0..n."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = np.maximum(starts[order], 0), np.minimum(np.maximum.accumulate(ends[order]), n)
    first = np.concatenate([[True], s[1:] > e[:-1]])
    return np.stack([s[first], e[np.append(np.nonzero(first)[0][1:], len(s)) - 1]], 1)


def _settled(text: bytes, spans: np.ndarray) -> tuple[int, int, int, bytes]:
    """(n_bytes, n_removed, n_spans, what is left)."""
    kept, last = [], 0
    for a, b in spans.tolist():
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    return len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(kept)


def _valid(kept: bytes) -> bytes:
    """Without the halves of characters that a cut went through."""
    return kept.decode("utf-8", "ignore").encode()


def _fetch(sorted_rows: DataFrame, keep_text: bool) -> DataFrame:
    """Documents without open contexts are done; of others, the spans found so far and the open contexts are handed on as rows."""
    row_kind = sorted_rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        own, repeats, open_ = None, [], []
        nobody = [None] * 20_000
        for batch in batches:
            done: list[tuple] = []
            done_at: list[int | None] = []
            contexts: list[tuple] = []
            for i, (doc, mark, kind) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("doc", "mark", "kind")), strict=True)):
                if (doc, mark) != own:
                    own, repeats, open_ = (doc, mark), [], []
                if kind != TEXT:
                    places = np.frombuffer(batch.column("data")[i].as_py(), "<u4")
                    if kind == REPEAT:
                        repeats.append(places)
                    else:
                        open_.append((kind, places))
                    continue
                text = expand.decompress(batch.column("data")[i].as_py())
                at = np.concatenate(repeats).astype(np.int64) if repeats else np.zeros(0, np.int64)
                spans = _cover(len(text), at - REACH, at + ANCHOR + REACH)
                done_at.append(None if open_ else i)
                if open_:
                    # a context inside one removed range has nothing left to decide, but others may repeat it
                    contexts += [(doc, mark, text[max(0, p - REACH) : p] + text[p + ANCHOR : p + ANCHOR + REACH], p, min(p, REACH), k, text[p : p + ANCHOR]) for k, places in open_ for p in places.tolist()]
                    done.append((doc, mark, None, spans.astype("<i8").tobytes(), None, None, None, None, None))
                else:
                    size, removed, n, kept = _settled(text, spans)
                    done.append((doc, mark, _valid(kept) if keep_text else None, None, size, removed, n, hashlib.sha256(kept).hexdigest(), None))
            if done:
                yield _fetched(done, batch.column("row").take(pa.array(done_at, pa.int64())))
            for i in range(0, len(contexts), 20_000):
                part = contexts[i : i + 20_000]
                doc, mark, text, at, left, kind, anchor = zip(*part, strict=True)
                none = nobody[: len(part)]
                yield _fetched(list(zip(doc, mark, text, none, at, left, kind, none, anchor, strict=True)), pa.nulls(len(part), batch.column("row").type))

    return sorted_rows.mapInArrow(run, f"doc long, mark long, text binary, spans binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, anchor binary, row {row_kind}")


def _fetched(rows: list[tuple], row: pa.Array) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc", "mark", "text", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "anchor", "row"]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), row], names)


def _ranked(h: np.ndarray, blocks_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in suffix order of their anchor and blocks, bytes in common with the row before; 0 for another anchor).

    The rows' symbols follow each other as one string, whose suffix array orders the rows by their first symbols.
    """
    n, width = blocks_.shape
    symbols = np.concatenate([h[:, None], blocks_], 1).reshape(-1)
    _, text = np.unique(symbols, return_inverse=True)
    array = suffix_array(text.reshape(-1) + 1)
    rows = (array[array % (width + 1) == 0]) // (width + 1)
    bytes_ = blocks_[rows].astype(">u8").view(np.uint8).reshape(n, width * 8)
    equal = np.concatenate([bytes_[1:] == bytes_[:-1], np.zeros((n - 1, 1), bool)], 1)
    common = np.zeros(n, np.int64)
    common[1:] = np.where(h[rows[1:]] == h[rows[:-1]], equal.argmin(1), -1)
    common[:1] = -1
    return rows, common


def _classes(anchors_: list[bytes], sides: list[bytes], left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context (an anchor, the bytes on both sides of it, how many are before it) a bit set.

    Bit a is on if the passage that begins a bytes before the anchor has a smaller document.
    """
    n, pad = len(sides), bytes(REACH)
    known: dict[bytes, int] = {}
    h = np.array([known.setdefault(x, len(known)) for x in anchors_], U)
    right = np.array([len(x) for x in sides]) - left
    after = np.frombuffer(b"".join([(x[k:] + pad)[:REACH] for x, k in zip(sides, left.tolist(), strict=True)]), ">u8").reshape(n, -1).astype(U)
    before = np.frombuffer(b"".join([(x[:k][::-1] + pad)[:REACH] for x, k in zip(sides, left.tolist(), strict=True)]), ">u8").reshape(n, -1).astype(U)
    behind, behind_common = _ranked(h, after)
    ahead, ahead_common = _ranked(h, before)
    bits = np.zeros(n, np.int64)
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(REACH + 1):
        by_right[behind] = np.cumsum(behind_common < REACH - a)
        by_left[ahead] = np.cumsum(ahead_common < a)
        rows = np.nonzero((left >= a) & (right >= REACH - a))[0]
        if len(rows) < 2:
            continue
        passage = by_right[rows] * (n + 1) + by_left[rows]
        order = np.lexsort((doc[rows], passage))
        rows, passage = rows[order], passage[order]
        first = np.concatenate([[True], passage[1:] != passage[:-1]])
        least = doc[rows][np.nonzero(first)[0]][np.cumsum(first) - 1]
        bits[rows[doc[rows] > least]] |= 1 << a
    return bits


def _as_marks(doc: list, mark: list, at: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    pairs = np.stack([at, bits], 1).astype("<i8")
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array([OPEN] * len(doc), pa.int32()), pa.array([x.tobytes() for x in pairs], pa.binary())], ["doc", "mark", "kind", "data"])


def _compare(contexts: DataFrame, partitions: int) -> DataFrame:
    """Marks for the open contexts: (document, text hash, OPEN, packed (place, bits)). The contexts of one anchor meet in one part."""

    def judge(held: list[tuple]) -> pa.RecordBatch | None:
        anchor, sides, left, doc, mark, at = zip(*held, strict=True)
        bits = _classes(list(anchor), list(sides), np.array(left), np.array(doc))
        hit = np.nonzero(bits)[0]
        return _as_marks([doc[i] for i in hit], [mark[i] for i in hit], np.array(at)[hit], bits[hit]) if len(hit) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "sides", "left", "doc", "mark", "at")), strict=True):
                if len(held) >= PART and row[0] != held[-1][0]:
                    if (found := judge(held)) is not None:
                        yield found
                    held = []
                held.append(row)
        if held and (found := judge(held)) is not None:
            yield found

    return contexts.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def _compare_crowded(contexts: DataFrame) -> DataFrame:
    """The same for contexts of anchors that have very many: their passages are grouped by their bytes, with minima before the shuffle."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, sides, left, doc, mark, at in zip(*(batch.column(x).to_pylist() for x in ("anchor", "sides", "left", "doc", "mark", "at")), strict=True):
                text = sides[:left] + anchor + sides[left:]
                out += [(text[left - a : left - a + MATCH], doc, mark, at, 1 << a) for a in range(max(0, left + MATCH - len(text)), left + 1)]
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["passage", "doc", "mark", "at", "bit"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _as_marks(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), np.array(batch.column("at")), np.array(batch.column("bits")))

    every = stored(contexts.mapInArrow(passages, "passage binary, doc long, mark long, at long, bit long"), "passages")
    least = every.groupBy("passage").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    hits = every.join(least, "passage").where("doc > least").groupBy("doc", "mark", "at").agg(F.bit_or("bit").alias("bits"))
    return hits.mapInArrow(marks, _FOUND)


def _finish(sorted_rows: DataFrame, keep_text: bool, schema) -> DataFrame:
    """The documents with open contexts (those that have SPANS), settled with what the comparison found as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        own, bits, spans = None, [], None
        for batch in batches:
            done, at = [], []
            for i, (doc, mark, kind) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("doc", "mark", "kind")), strict=True)):
                if (doc, mark) != own:
                    own, bits, spans = (doc, mark), [], None
                data = batch.column("data")[i].as_py()
                if kind == OPEN:
                    bits.append(np.frombuffer(data, "<i8"))
                elif kind == SPANS:
                    spans = np.frombuffer(data, "<i8").reshape(-1, 2)
                elif spans is not None:
                    data = expand.decompress(data)
                    cut = spans
                    if bits:
                        place, set_ = np.stack(bits).T
                        which, a = np.nonzero((set_[:, None] >> np.arange(REACH + 1)) & 1)
                        start = place[which] - a
                        cut = _cover(len(data), np.concatenate([spans[:, 0], start]), np.concatenate([spans[:, 1], start + MATCH]))
                    size, removed, n, kept = _settled(data, cut)
                    done.append((doc, mark, _valid(kept) if keep_text else None, None, size, removed, n, hashlib.sha256(kept).hexdigest(), None))
                    at.append(i)
            if done:
                yield _fetched(done, batch.column("row").take(pa.array(at)))

    return sorted_rows.mapInArrow(run, schema)


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_text: bool = True, hot: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Cut every byte that lies in a MATCH-byte string which also begins in a document with a smaller key.

    Returns the columns of docs but for the text inside ``row``, n_bytes, n_removed, n_spans (joined removed ranges),
    kept_sha256 (of the bytes left) and ``kept`` (these as text, without halves of cut characters; null with keep_text=False). Texts are whole UTF-8 byte strings; null
    counts as empty; strings never cross documents and are judged on the input. Rows with equal keys don't remove each
    other's bytes, nor do repeats within one text. A null key counts as larger than any other. Names of columns don't
    matter, as they stay inside ``row``. hot: contexts of an anchor from
    which on they are grouped by Spark, by default as HOT_BYTES says; bucket_rows: as BUCKET_ROWS. Both change the way, not the result.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    partitions = _partitions(spark)
    _, size = total_bytes(docs, text)
    wanted = -(-size // BUCKET_TEXT)
    names = _bucket_names(spark, partitions) if wanted <= partitions else list(range(wanted))
    hot = min(PART, size // HOT_BYTES + 1) if hot is None else hot
    crowd = max(2, bucket_rows // (size // ANCHOR_BLOCK + 1))
    none = F.lit((1 << 63) - 1)
    texts = docs.select(F.coalesce(F.col(key).cast("long"), none).alias("doc"), F.hash(F.col(text)).cast("long").alias("mark"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    fetched = stored(_fetch(_by_document(texts, _find(_anchor_rows(texts, names, crowd), partitions, hot), partitions), keep_text), "texts", release=True)
    closed = fetched.where("spans is null and anchor is null")
    spans = fetched.where("spans is not null").select("doc", "mark", F.lit(SPANS).alias("kind"), F.col("spans").alias("data"))
    contexts = fetched.where("anchor is not null").select("anchor", F.col("text").alias("sides"), F.col("n_removed").alias("left"), "doc", "mark", F.col("n_bytes").alias("at"), F.col("n_spans").alias("kind"))
    marks = _compare(contexts.where(F.col("kind") == OPEN), partitions).unionByName(_compare_crowded(contexts.where(F.col("kind") == CROWDED)))
    whole = closed.unionByName(_finish(_by_document(texts, marks.unionByName(spans), partitions), keep_text, fetched.schema))
    return whole.select("row", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("text").cast("string").alias("kept"))
