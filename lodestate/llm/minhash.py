"""Near-duplicate documents by bottom-k MinHash sketches from one hash function.

1. Every document's distinct word shingles are hashed once; documents with equal words form a class with one
   representative. The k smallest hashes of a set are its sketch.
2. Inverted lists of retained values generate overlaps. A sketch's values are ordered from rare to frequent, and only
   its first values are listed: two sketches that share ``overlap`` values must meet in these lists, and a passage that
   many documents hold doesn't make lists of them.
3. First, each document is paired with the most central member of the lists it is in, so a group of n copies costs
   about n pairs; exact Jaccard on the words verifies them. Documents that lists connect are a family. Where these
   links leave a family in several components, its documents are listed once more with sketches of FINE values (for most
   texts, that is their whole sets): documents that have a page layout in common, but no more, meet in no list then.
   In what these lists still connect, the documents outside the largest component meet the others in blocks: the
   union-sketch estimate filters a block's pairs, exact Jaccard verifies the others, and a block emits only links that
   join components.
4. Components: label propagation over links, with written tables between rounds.

Hashes only choose candidates. Links are confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import LOWER, U, bounded_arrow, map_blocks, mix, stored, text_view, word_hashes, word_spans

#: Words of a shingle.
SHINGLE = 5
#: Retained values of a sketch.
SKETCH = 64
#: Share of true pairs that sketches may miss.
MISSED = 1e-6
#: Links (16 bytes each) that one task may join.
LOCAL_LINKS = 1_000_000
#: Values of the sketches by which families of several components are listed once more.
FINE = 1024
#: Documents on either side of a block, and their shingles together (a document of more is a side of its own).
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Parts that the rows of one family are dealt into when facts of the family are joined to them.
SALTS = 32

_SPACE = np.ones(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def overlap_of(percent: int, k: int = SKETCH) -> int:
    """The most that two sets of Jaccard percent / 100 share of the k smallest values of their union in all but MISSED of cases.

    Each of these is shared with that probability (binomial tail). Raises where even one value is too much to ask for.
    """
    p, tail, n = percent / 100, 0.0, 0
    while n < k and (tail := tail + comb(k, n) * p**n * (1 - p) ** (k - n)) < MISSED:
        n += 1
    if not n:
        raise ValueError(f"sketches of {k} values miss too many pairs of {percent} percent: use more")
    return n


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, their bounds)."""
    raw, offsets = text_view(column)
    low, n = LOWER[raw], len(column)
    starts, ends, rows = word_spans(_SPACE[low], offsets)
    words = word_hashes(low, starts, ends)
    first = np.searchsorted(rows, np.arange(n + 1))
    size = np.diff(first)
    value = np.zeros(len(words), U)
    for i in range(shingle):  # the words there are, so that short texts are one shingle
        inside = np.nonzero(rows[i:] == rows[: len(rows) - i])[0] if i else np.arange(len(words))
        value[inside] += mix(words[inside + i] + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
    keep = np.arange(len(words)) - first[rows] < np.maximum(1, size - shingle + 1)[rows]
    value, rows = mix(value[keep]) >> U(1), rows[keep]  # 63 bits: the same order with and without a sign
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(n + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def normal_words(raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Each text's words, lower-cased, with a space between."""
    data = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield b" ".join(data[a:b].lower().split())


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch): the set's size, a 128-bit digest of the words (null if there are none), the k smallest values."""

    def make(block: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(block.column("text"))
        size = np.diff(bounds)
        digests = [hashlib.blake2b(w, digest_size=16).digest() if w else None for w in normal_words(*text_view(block.column("text")))]
        # values are uniform 64-bit hashes in unsigned order, so the first k are the bottom-k sketch
        take = np.minimum(size, k)
        at = np.repeat(bounds[:-1] - np.cumsum(take) + take, take) + np.arange(take.sum())
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), _lists(values[at], np.concatenate([[0], np.cumsum(take)]))], ["doc_id", "n_shingles", "digest", "sketch"])

    return map_blocks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", make, "doc_id long, n_shingles long, digest binary, sketch array<bigint>")


def listed_values(classes: DataFrame, *, percent: int, overlap: int, k: int = SKETCH) -> DataFrame:
    """(v, doc_id, n, df): the inverted lists' rows, of classes (doc_id, tag, n_shingles, sketch). df: sketches that hold v.

    Values that one sketch alone holds take their place but need no list. tag tells sketches of one doc_id apart.
    """
    each = classes.select("doc_id", "tag", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    shared = each.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = each.join(shared, "v")
    own = rows.groupBy("doc_id", "tag", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    held = F.least("n", F.lit(k))
    # of a set so small that its partners are no larger than k either, sketches are whole sets: a partner has percent of it
    whole = F.ceil(F.col("n") * percent / 100)
    needed = F.when(F.col("n") * 100 <= k * percent, whole).when(F.col("n") < k, F.ceil(F.col("n") * overlap / k)).otherwise(F.lit(overlap))
    prefix = held - needed + 1 - (held - F.size("shared"))
    return own.withColumn("take", prefix.cast("int")).where("take > 0").select("doc_id", "n", F.explode(F.slice("shared", 1, F.col("take"))).alias("s")).select(F.col("s.v").alias("v"), "doc_id", "n", F.col("s.df").alias("df"))


#: Lists of more documents are dealt into SALTS parts when facts of the list are joined to its rows.
LONG_LIST = 500


def _parts_of_lists(df: Column) -> Column:
    return F.when(df > LONG_LIST, F.lit(SALTS)).otherwise(F.lit(1))


def _with_list(lists: DataFrame, facts: DataFrame) -> DataFrame:
    """lists' rows with facts (v, df, ...), one row of which stands for each list."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), _parts_of_lists(F.col("df")) - 1))).drop("df")
    return lists.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), _parts_of_lists(F.col("df"))).cast("int")).join(salted, ["v", "_salt"])


def stars(lists: DataFrame) -> DataFrame:
    """(a, b): each document b and the most central member a of its lists, the one that most of its lists have.

    Central is who shares most: the sum of its listed values' frequencies.
    """
    centrality = lists.groupBy("doc_id").agg(F.sum("df").alias("shared"))
    hubs = lists.join(centrality, "doc_id").groupBy("v").agg(F.max_by("doc_id", F.struct("shared", -F.col("doc_id"))).alias("a"), F.max("df").alias("df"))
    votes = _with_list(lists, hubs).where("a != doc_id").groupBy("doc_id", "a").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("doc_id").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", F.col("doc_id").alias("b"))


def families(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, family): documents that lists connect, verified or not. Every link lies within a family."""
    least = lists.groupBy("v").agg(F.min("doc_id").alias("a"), F.max("df").alias("df"))
    edges = _with_list(lists, least).where("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    return components(nodes, stored(edges, "edges")).withColumnRenamed("component_id", "family")


def open_families(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of families of several components: doc_id, n, family, component_id; those families' facts), both stored.

    The facts: main (the largest component), and documents and shingles of the family (n, size) and outside of main.
    """
    rows = members.join(parts, "doc_id")
    counts = rows.groupBy("family", "component_id").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    facts = stored(
        counts.groupBy("family")
        .agg(F.max_by(F.struct("component_id", "m", "s"), F.struct("m", "component_id")).alias("main"), F.sum("m").alias("n"), F.sum("s").alias("size"))
        .where("n > main.m")
        .select("family", F.col("main.component_id").alias("main"), "n", "size", (F.col("n") - F.col("main.m")).alias("n_out"), (F.col("size") - F.col("main.s")).alias("size_out")),
        "families",
    )
    return stored(_with_family(rows, facts.select("family")), "open"), facts


def _with_family(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with their family's facts; the rows of one family are dealt into SALTS parts for it."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["family", "_salt"]).drop("_salt")


def open_blocks(members: DataFrame, parts: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(family, i, j, x, doc_id, component_id): what is left to compare in families of several components.

    members: (doc_id, n, family), n: size of the set. x is true for the documents outside a family's largest component:
    they meet all of the family. Both sides are dealt into blocks of about so many documents and shingles, and each
    pair of blocks is a task's work; a family of n with r outside makes about n * r / block rows.
    """
    rows, facts = open_families(members, parts)
    blocks_of = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / shingles)).cast("int")
    placed = _with_family(rows, facts.select("family", "main", blocks_of(F.col("n_out"), F.col("size_out")).alias("ni"), blocks_of(F.col("n"), F.col("size")).alias("nj")))
    of = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = placed.where("component_id != main").select("family", of("ni").alias("i"), every("nj").alias("j"), F.lit(True).alias("x"), "doc_id", "component_id")
    return outside.unionByName(placed.select("family", every("ni").alias("i"), of("nj").alias("j"), F.lit(False).alias("x"), "doc_id", "component_id"))


def fine_lists(docs: DataFrame, ids: DataFrame, *, percent: int, k: int = FINE) -> DataFrame:
    """The lists of ``listed_values`` from sketches of k values, of the documents in ids (doc_id) alone."""
    made = sketches(docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), k=k).where("digest is not null")
    one = made.withColumn("tag", F.hash("digest")).dropDuplicates(["doc_id", "digest"]).drop("digest")
    return listed_values(stored(one, "fine"), percent=percent, overlap=overlap_of(percent, k), k=k)


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all sets in x and in y."""
    xs, ys = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.repeat(np.arange(len(y)), [len(v) for v in y])
    value, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    ax, ay = at[: len(xs)], at[len(xs) :]
    both = (np.bincount(ax, minlength=len(value)) > 0) & (np.bincount(ay, minlength=len(value)) > 0)
    column = np.cumsum(both) - 1
    out = np.zeros((len(x), len(y)), np.float32)
    kx, ky = both[ax], both[ay]
    xs, ax, ys, ay = xs[kx], column[ax[kx]], ys[ky], column[ay[ky]]
    for low in range(0, int(both.sum()), 4096):
        one, two = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        px, py = (ax >= low) & (ax < low + 4096), (ay >= low) & (ay < low + 4096)
        one[xs[px], ax[px] - low] = 1
        two[ys[py], ay[py] - low] = 1
        out += one @ two.T
    return out.astype(np.int64)


def _links_of(ids: list[int], parts: list[int], outside: list[bool], sets: list[np.ndarray], percent: int, k: int, overlap: int) -> list[tuple[int, int]]:
    """Links of one pair of blocks: of all that hold, those that join components that weren't joined yet."""
    x, y = [i for i, o in enumerate(outside) if o], [i for i, o in enumerate(outside) if not o]
    if not x or not y:
        return []
    sizes = np.array([len(v) for v in sets])
    least, most = np.minimum(sizes[x][:, None], sizes[y]), np.maximum(sizes[x][:, None], sizes[y])
    label = np.array(parts)
    maybe = (least * 100 >= most * percent) & (label[x][:, None] != label[y])
    # the union sketch: a set's values are sorted, so its first k are its sketch
    maybe &= _common([sets[i][:k] for i in x], [sets[i][:k] for i in y]) * k >= np.minimum(least, k) * overlap
    rows, columns = np.nonzero(maybe.any(1))[0], np.nonzero(maybe.any(0))[0]
    if not len(rows):
        return []
    common = _common([sets[x[i]] for i in rows], [sets[y[j]] for j in columns])
    union = sizes[x][rows][:, None] + sizes[y][columns] - common
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for r, c in zip(*np.nonzero((100 * common >= percent * union) & maybe[np.ix_(rows, columns)]), strict=True):
        a, b = x[rows[r]], y[columns[c]]
        one, two = find(parts[a]), find(parts[b])
        if one != two:
            root[max(one, two)] = min(one, two)
            out.append((ids[a], ids[b]))
    return out


def _with_sets(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with ``values``, the packed shingle set. Only the texts of documents in rows are read."""

    def make(block: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(block.column("text"))
        packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "values"])

    ids = rows.select("doc_id").distinct()
    return rows.join(map_blocks(docs.join(ids, "doc_id", "left_semi"), "text", make, "doc_id long, values binary").distinct(), "doc_id")


def residual_links(blocks_: DataFrame, docs: DataFrame, *, percent: int, k: int = SKETCH, overlap: int | None = None) -> DataFrame:
    """(a, b): true links between components of a family, found block by block on the full sets. No pair is emitted that isn't a link."""
    overlap = overlap_of(percent, k) if overlap is None else overlap
    rows = _with_sets(blocks_, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, ([], [], [], [])

        def close() -> Iterator[pa.RecordBatch]:
            found = _links_of(*held, percent, k, overlap)
            for column in held:
                column.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            for n, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True)):
                if key != own:
                    yield from close()
                    own = key
                for column, name in zip(held, ("doc_id", "component_id", "x"), strict=False):
                    column.append(batch.column(name)[n].as_py())
                held[3].append(np.frombuffer(batch.column("values")[n].as_py(), U))
        yield from close()

    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long")


def shared_shingles(x: bytes, y: bytes, shingle: int = SHINGLE) -> tuple[int, int]:
    """(shingles that both texts have, that any of them has). Words are told apart by their bytes; nothing is hashed to fewer bits."""
    words = [t.split(b" ") if t else [] for t in (x, y)]
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(w, len(known)) for own in words for w in own], np.int64)
    found = []
    first = 0
    # pairs of numbers become numbers again: of 2, 4, ... words, and at last of a whole shingle
    sizes = [len(own) for own in words]
    if min(sizes) < shingle:
        sets = [{tuple(own[i : i + shingle]) for i in range(max(1, len(own) - shingle + 1))} if own else set() for own in words]
        return len(sets[0] & sets[1]), len(sets[0] | sets[1])
    pairs = lambda a, b: np.unique(a << 32 | b, return_inverse=True)[1].reshape(-1)
    done, width = number, 1
    while width < shingle:
        step = min(width, shingle - width)
        done, width = pairs(done[:-step], done[step:]), width + step
    for n in sizes:
        found.append(np.unique(done[first : first + n - shingle + 1]))
        first += n
    merged = np.concatenate(found)
    union = len(np.unique(merged))
    return len(merged) - union, union


def verified(pairs: DataFrame, docs: DataFrame, *, percent: int) -> DataFrame:
    """Those (a, b) with 100 * |A & B| >= percent * |A | B|, on the full sets of shingles, by their words.

    Ids that have several texts are linked if any of these are.
    """

    def make(block: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([squeeze.compress(w) for w in normal_words(*text_view(block.column("text")))], pa.binary())], ["doc_id", "words"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = map_blocks(docs.join(ids, "doc_id", "left_semi"), "text", make, "doc_id long, words binary").distinct()
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "words": "y"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "words": "x"}), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                common, union = shared_shingles(expand.decompress(x.as_py()), expand.decompress(y.as_py()))
                keep.append(union > 0 and 100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "ok"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, ok boolean").where("ok").select("a", "b")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) of all ends of the links in one task: union and find, the smaller root stays."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        top = v
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[v] != top:
            root[v], v = top, root[v]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            one, two = find(a), find(b)
            if one != two:
                root[max(one, two)] = min(one, two)
    if root:
        ends = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([find(v) for v in ends], pa.int64())], ["v", "c"])


def components(nodes: DataFrame, links: DataFrame, node: str = "doc_id", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(doc_id, component_id): the smallest node that each can reach. links must be a stored table.

    Up to local_links links (they are counted first) are joined by one task. More go through rounds of neighbours' minima
    and pointer jumps with stored labels. A round aggregates minima before its shuffle; a jump joins the labels of roots
    alone, SALTS times, so that the nodes of one giant component are dealt over as many parts.
    """
    if links.count() <= local_links:
        labels = links.select("a", "b").coalesce(1).mapInArrow(_joined, "v long, c long")
        return nodes.join(labels, F.col(node) == F.col("v"), "left").select(node, F.coalesce("c", node).alias("component_id"))
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(nodes.join(edges.select(F.col("a").alias(node)).distinct(), node, "left_semi").select(F.col(node).alias("v"), F.col(node).alias("c")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        lower = stored(lower, "lower")
        tops = lower.select(F.col("c").alias("root")).distinct().join(lower.select(F.col("v").alias("root"), F.col("c").alias("top")), "root")
        up = tops.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = lower.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        after = stored(dealt.join(up, (dealt["c"] == up["root"]) & (dealt["s"] == up["s"]), "left").select("v", "old", F.least("c", F.coalesce("top", "c")).alias("c")), "labels")
        changed = after.where("c != old").limit(1).count()
        labels = after.select("v", "c")
        if not changed:
            return nodes.join(labels, F.col(node) == F.col("v"), "left").select(node, F.coalesce("c", node).alias("component_id"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85, k: int = SKETCH, overlap: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: kept is the smallest id of each component.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of word shingles. Null, empty and wordless
    texts have no shingle and no link. Rows with equal ids and equal texts stay rows of their own; rows with one id and
    different texts are linked through that id. A row without an id has no link and no component. Texts of any length
    are taken whole; other columns aren't read. overlap: values that sketches of a link must share; by default all that
    percent and k allow to ask for.
    """
    overlap = overlap_of(percent, k) if overlap is None else overlap
    bounded_arrow(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    facts = stored(sketches(plain, k=k), "sketches")
    # classes of equal words: the smallest id stands for all; map-side minima keep a class of many copies cheap
    firsts = facts.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = stored(firsts.where("doc_id is not null").withColumn("tag", F.hash("digest")), "classes")
    lists = stored(listed_values(classes, percent=percent, k=k, overlap=overlap), "lists", release=True)
    nodes = classes.select("doc_id").distinct()
    links = stored(verified(stored(stars(lists), "stars"), plain, percent=percent), "links")
    parts = stored(components(nodes, links), "parts")
    sizes = lists.groupBy("doc_id").agg(F.max("n").alias("n"))
    open_, _ = open_families(families(lists, sizes.select("doc_id")).join(sizes, "doc_id"), parts)
    again = stored(fine_lists(plain, open_, percent=percent), "lists", release=True)
    sizes = again.groupBy("doc_id").agg(F.max("n").alias("n"))
    blocks_ = stored(open_blocks(families(again, sizes.select("doc_id")).join(sizes, "doc_id"), parts), "blocks")
    more = stored(residual_links(blocks_, plain, percent=percent, k=k, overlap=overlap), "links")
    # ids whose rows have several texts join what each of these is in
    same = facts.where("digest is not null and doc_id is not null").select("doc_id", "digest").distinct().join(classes.select("digest", F.col("doc_id").alias("class_id")), "digest").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.collect_set("class_id").alias("bs")).where("size(bs) > 1")
    whole = components(nodes, stored(links.union(verified(more, plain, percent=percent)).union(same.select("a", F.explode("bs").alias("b")).where("a != b")), "links"))
    ids = classes.select("digest", F.col("doc_id").alias("class_id")).join(whole.withColumnRenamed("doc_id", "class_id"), "class_id")
    found = facts.join(ids, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that aren't the first of their component; columns as they are.

    Rows of one id stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, key=key, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(key).cast("long") == F.col("_gone"), "left_anti")
