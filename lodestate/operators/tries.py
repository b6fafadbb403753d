"""Merkle-Patricia tries as set computations.

A trie is a function of its live keys, so nothing is inserted or collapsed: common prefixes of sorted neighbours give
branches, extensions and leaves. Leaves are dealt by trie and leading nibbles into whole sub-tries of bounded size; each
becomes one item (a leaf or a branch with its hash), and the items of the deepest parts are what the parts above work on.
All tries (the state's and every account's storage) go through the same few shuffles together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rlp
from ..functions.keccak import EMPTY_TREE, keccak256, keccak256_many
from ..functions.paths import PATH_LENGTH, common_prefix
from ..sources.shared import stored

#: Keys that one window task sorts, about.
KEYS_PER_TASK = 1 << 20


def neighbours(keys: DataFrame, trie: str = "trie", path: str = "path", bucket_nibbles: int | None = None) -> DataFrame:
    """keys with ``left`` and ``right``: nibbles in common with the key before and after in the trie, -1 at its ends.

    Keys are sorted within (trie, leading nibbles). The number of leading nibbles follows from the number of keys; the
    borders between these ranges are settled on a table of their first and last keys, of at most 16 ** nibbles rows a trie.
    """
    if bucket_nibbles is None:
        bucket_nibbles, n = 0, keys.count()
        while n > KEYS_PER_TASK and bucket_nibbles < 6:
            bucket_nibbles, n = bucket_nibbles + 1, n // 16
    bucket = F.substr(F.col(path), F.lit(1), F.lit(bucket_nibbles))
    own = Window.partitionBy(trie, "_bucket").orderBy(path)
    rows = keys.withColumn("_bucket", bucket).withColumn("_before", F.lag(path).over(own)).withColumn("_after", F.lead(path).over(own))
    if bucket_nibbles:
        ends = rows.groupBy(trie, "_bucket").agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
        along = Window.partitionBy(trie).orderBy("_bucket")
        ends = ends.select(trie, "_bucket", F.lag("hi").over(along).alias("_prev_hi"), F.lead("lo").over(along).alias("_next_lo"))
        rows = rows.join(ends, [trie, "_bucket"]).withColumn("_before", F.coalesce("_before", "_prev_hi")).withColumn("_after", F.coalesce("_after", "_next_lo"))
    lcp = lambda other: F.when(F.col(other).isNull(), F.lit(-1)).otherwise(common_prefix(F.col(path), F.col(other)))
    return rows.withColumn("left", lcp("_before")).withColumn("right", lcp("_after")).select(*keys.columns, "left", "right")


#: Leaves of one trie that one task reduces at once. Larger tries are dealt by leading nibbles, so deep that no part has more.
SUBTRIE = 1 << 15
#: Nibbles by which a part that is too large is dealt further.
STEP = 2
#: Rows that a task holds before it works on the whole parts among them.
HELD = 20_000
#: Leaves of a task, about.
LEAVES_PER_TASK = 50_000

_ITEM = "trie string, path string, leaf boolean, node binary, kind string, node_path string, children int, ref binary, level int"


def _lengths(data: int, short: int, long_: int) -> bytes:
    """RLP header for so many bytes."""
    if data < 56:
        return bytes([short + data])
    size = data.to_bytes((data.bit_length() + 7) // 8, "big")
    return bytes([long_ + len(size)]) + size


def _string(data: bytes) -> bytes:
    return data if len(data) == 1 and data[0] < 0x80 else _lengths(len(data), 0x80, 0xB7) + data


def _path_node(path: str, flags: int, content: bytes) -> bytes:
    """RLP of (hex-prefix path, content); flags: 2 for a leaf, 0 for an extension."""
    compact = bytes.fromhex(f"{flags + 1}{path}" if len(path) % 2 else f"{flags}0{path}")
    body = _string(compact) + content
    return _lengths(len(body), 0xC0, 0xF7) + body


def _references(nodes: list[bytes]) -> list[bytes]:
    """How parents hold these nodes: themselves below 32 bytes, else their hash."""
    long_ = [i for i, x in enumerate(nodes) if len(x) >= 32]
    out = list(nodes)
    for i, digest in zip(long_, keccak256_many([nodes[i] for i in long_]), strict=True):
        out[i] = b"\xa0" + digest
    return out


class _Part:
    """Whole sub-tries as sorted items (leaves, and branches that were made before), worked on together from the deepest fork up.

    hashes: False leaves all hashes out, for the structure alone. keep: collect rows for every node that is made.

    A node has the place of its first item. Of a row, the forks (branches and extensions) below it at its place are noted;
    those over each place are known when all are made, and their difference is the row's level.
    """

    def __init__(self, hashes: bool, keep: bool, items: int) -> None:
        self.hashes, self.keep = hashes, keep
        self.rows: list[tuple] = []
        self.at: list[int] = []
        self.below: list[int] = []
        self.so_far = np.zeros(items, np.int32)
        self.steps = np.zeros(items + 1, np.int32)

    def _keep(self, rows: list[tuple], place: np.ndarray, end: np.ndarray | None = None) -> None:
        """Collect rows; end: where forks' items end, None for leaves."""
        self.rows += rows
        self.at += place.tolist()
        self.below += [0] * len(place) if end is None else (self.so_far[place] + 1).tolist()
        if end is not None:
            self.so_far[place] += 1
            self.steps[place] += 1
            self.steps[end] -= 1

    def kept(self, trie: list[str], path: list[str], leaf: list[bool]) -> list[tuple]:
        """The rows with their levels, counted from the part's top, and those of the part's own branches among the items (kind ``item``)."""
        if not self.keep:
            return []
        over = np.cumsum(self.steps[:-1])
        levels = (over[self.at] - np.array(self.below, np.int32)).tolist() if self.at else []
        items = [(trie[i], path[i], False, None, "item", None, None, None, int(over[i])) for i, is_leaf in enumerate(leaf) if not is_leaf]
        return [(*r, n) for r, n in zip(self.rows, levels, strict=True)] + items

    def _as_children(self, trie: list[str], path: list[str], leaf: list[bool], node: list[bytes], at: list[int], place: np.ndarray, end: np.ndarray) -> list[bytes]:
        """References of items as children of branches at depths at - 1 (their own path begins at ``at``)."""
        tails = [p[a:] for p, a in zip(path, at, strict=True)]
        if self.hashes:
            first = [_path_node(t, 2, _string(n)) if is_leaf else n for t, n, is_leaf in zip(tails, node, leaf, strict=True)]
            refs = _references(first)
            longer = [i for i, (t, is_leaf) in enumerate(zip(tails, leaf, strict=True)) if t and not is_leaf]
            extended = _references([_path_node(tails[i], 0, refs[i]) for i in longer])
        else:
            refs, longer = [b""] * len(path), [i for i, (t, is_leaf) in enumerate(zip(tails, leaf, strict=True)) if t and not is_leaf]
            extended = [b""] * len(longer)
        if self.keep:
            leaves = [i for i, is_leaf in enumerate(leaf) if is_leaf]
            self._keep([(trie[i], path[i][: at[i]], True, None, "leaf", tails[i], 0, refs[i]) for i in leaves], place[leaves])
            self._keep([(trie[i], path[i][: at[i]], False, None, "extension", tails[i], 0, ref) for i, ref in zip(longer, extended, strict=True)], place[longer], end[longer])
        for i, ref in zip(longer, extended, strict=True):
            refs[i] = ref
        return refs

    def reduce(self, group: np.ndarray, trie: list[str], path: list[str], leaf: list[bool], node: list[bytes]) -> list[tuple]:
        """One item for each group: a leaf, or the group's topmost branch."""
        n = len(path)
        trie_, path_, leaf_, node_ = (np.array(x, object) for x in (trie, path, leaf, node))
        width = max(map(len, path), default=0)
        chars = np.frombuffer("".join([p.ljust(width, "-") for p in path]).encode(), np.uint8).reshape(n, width) if width else np.zeros((n, 0), np.uint8)
        size = np.array([len(p) for p in path])
        equal = np.concatenate([chars[1:] == chars[:-1], np.zeros((max(0, n - 1), 1), bool)], 1)
        shared = np.where(group[1:] == group[:-1], np.minimum(equal.argmin(1), np.minimum(size[1:], size[:-1])), -1)
        left, right = np.concatenate([[-1], shared]), np.concatenate([shared, [-1]])
        alive = np.arange(n)
        after = lambda: np.append(alive[1:], n)
        while len(alive) and (depth := max(left[alive].max(), right[alive].max())) >= 0:
            joined = right[alive] == depth  # with the item after it
            mine = joined | (left[alive] == depth)
            first = np.nonzero(mine & (left[alive] != depth))[0]
            ends = np.nonzero(mine & ~joined)[0]
            own, end = alive[mine], after()
            refs = self._as_children(trie_[own].tolist(), path_[own].tolist(), leaf_[own].tolist(), node_[own].tolist(), [depth + 1] * len(own), own, end[mine])
            nibbles = [int(p[depth], 16) for p in path_[own].tolist()]
            bounds = np.cumsum(ends - first + 1).tolist()
            made, masks = [], []
            for low, high in zip([0, *bounds[:-1]], bounds, strict=True):
                masks.append(sum(1 << k for k in nibbles[low:high]))
                if self.hashes:
                    items = [b"\x80"] * 17
                    for k, ref in zip(nibbles[low:high], refs[low:high], strict=True):
                        items[k] = ref
                    body = b"".join(items)
                    made.append(_lengths(len(body), 0xC0, 0xF7) + body)
                else:
                    made.append(b"")
            at = alive[first]
            prefixes = [p[:depth] for p in path_[at].tolist()]
            if self.keep:
                own_refs = _references(made) if self.hashes else made
                self._keep([(t, p, False, None, "branch", "", m, r) for t, p, m, r in zip(trie_[at].tolist(), prefixes, masks, own_refs, strict=True)], at, end[ends])
            path_[at], node_[at], leaf_[at] = prefixes, made, False
            right[at] = right[alive[ends]]
            gone = mine.copy()
            gone[first] = False
            alive = alive[~gone]
        self.tops_at = alive, after()
        return [(trie_[i], path_[i], bool(leaf_[i]), node_[i], None, None, None, None, None) for i in alive]

    def tops(self, trie: list[str], path: list[str], leaf: list[bool], node: list[bytes]) -> list[tuple]:
        """Rows of kind ``root``: the hash of each whole trie."""
        refs = self._as_children(trie, path, leaf, node, [0] * len(path), *self.tops_at)
        if not self.hashes:
            return []
        whole = [_path_node(p, 2, _string(x)) if is_leaf else x if not p else _path_node(p, 0, r) for p, is_leaf, x, r in zip(path, leaf, node, _references([b"" if is_leaf else x for is_leaf, x in zip(leaf, node, strict=True)]), strict=True)]
        return [(t, "", False, None, "root", "", 0, d, None) for t, d in zip(trie, keccak256_many(whole), strict=True)] if refs else []


def _reduced(items: DataFrame, level: int, hashes: bool, keep: bool, tasks: int | None = None) -> DataFrame:
    """items (trie, path, leaf, node) reduced to one for each (trie, first ``level`` nibbles); at level 0, to roots. keep: nodes as rows, too.

    tasks: among how many the parts are dealt; Spark's own number is by bytes, of which hashing takes long.
    """
    prefix = F.substr(F.col("path"), F.lit(1), F.lit(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bool, bytes]] = []

        def work(rows: list[tuple[str, str, bool, bytes]]) -> pa.RecordBatch:
            trie, path, leaf, node = (list(x) for x in zip(*rows, strict=True))
            part = _Part(hashes, keep, len(rows))
            new = [i == 0 or trie[i] != trie[i - 1] or path[i][:level] != path[i - 1][:level] for i in range(len(rows))]
            out = part.reduce(np.cumsum(new), trie, path, leaf, node)
            if level == 0:
                out = part.tops(*(list(x) for x in zip(*[x[:4] for x in out], strict=True)))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int32())
            rows = out + part.kept(trie, path, leaf)
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _ITEM.split(", ")])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("trie", "path", "leaf", "node")), strict=True)
            if len(held) >= HELD:
                key = held[-1][0], held[-1][1][:level]
                at = len(held)
                while at and (held[at - 1][0], held[at - 1][1][:level]) == key:
                    at -= 1
                if at:
                    yield work(held[:at])
                    held = held[at:]
        if held:
            yield work(held)

    dealt = items.select("trie", "path", "leaf", "node").repartition(*([tasks] if tasks else []), F.col("trie"), prefix).sortWithinPartitions("trie", "path")
    return dealt.mapInArrow(run, _ITEM)


def _levels(leaves: DataFrame, subtrie: int) -> dict[int, DataFrame]:
    """The leaves by the number of nibbles by which each is dealt: so many that no part has more than subtrie leaves."""
    found: dict[int, DataFrame] = {}
    rest, level = leaves, 0
    while True:
        prefix = F.substr(F.col("path"), F.lit(1), F.lit(level))
        large = stored(rest.groupBy("trie", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > subtrie).select("trie", "_p"), "large")
        if large.limit(1).count() == 0:
            return found | {level: rest}
        salted = large.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        keyed = rest.withColumn("_p", prefix).withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(16)).cast("int"))
        found[level] = keyed.join(salted, ["trie", "_p", "_s"], "left_anti").select(leaves.columns)
        rest = stored(keyed.join(salted, ["trie", "_p", "_s"], "left_semi").select(leaves.columns), "rest")
        level += STEP


def reduced(leaves: DataFrame, *, hashes: bool = True, keep: bool = False, subtrie: int = SUBTRIE) -> tuple[DataFrame, DataFrame | None]:
    """((trie, root), nodes) of all tries among leaves (trie, path, value: the encoded leaf value), both stored.

    A task turns whole sub-tries of bounded size into one item each; the deepest parts go first, and theirs are items of
    the parts above. Most tries are one part. nodes: (trie, path, kind, node_path, children, ref, level: branches
    and extensions above), with keep. Of one (trie, path), leaves must have one row. Tries without leaves have no row.
    """
    all_leaves = stored(leaves.select("trie", "path", F.lit(True).alias("leaf"), F.col("value").alias("node")), "leaves")
    tasks = 1 + all_leaves.count() // LEAVES_PER_TASK
    dealt = _levels(all_leaves, subtrie)
    made: list[DataFrame] = []
    for level in range(max(dealt), -1, -STEP):
        pool = dealt[level]
        if made:
            pool = pool.unionByName(made[-1].where("kind is null").select(pool.columns))
        made.append(stored(_reduced(pool, level, hashes, keep, tasks), "nodes"))
    tops = made[-1].where("kind = 'root'").select("trie", F.col("ref").alias("root"))
    return tops, _leveled(made[::-1]) if keep else None


def _leveled(made: list[DataFrame]) -> DataFrame:
    """The nodes of parts, the topmost first, with levels counted from their trie's root: a part's top lies where the part above has it."""
    out, above = [], None
    for i, rows in enumerate(made):
        if above is not None:
            prefix = lambda: F.substr(F.col("path"), F.lit(1), F.lit(i * STEP))  # noqa: B023, E731
            # one row a part: read back, so that it is known to be small
            tops = stored(above.where("kind = 'item'").select(F.col("trie").alias("_t"), prefix().alias("_p"), F.col("level").alias("_top")), "tops")
            rows = rows.where("kind is not null").join(tops, (F.col("trie") == F.col("_t")) & (prefix() == F.col("_p")), "left").withColumn("level", F.col("level") + F.col("_top"))
        above = rows
        out.append(rows.where("kind in ('leaf', 'branch', 'extension')").select("trie", "path", "kind", "node_path", "children", "ref", "level"))
    return reduce(DataFrame.unionByName, out)


def structure(keys: DataFrame, trie: str = "trie", path: str = "path", levels: bool = False) -> DataFrame:
    """(trie, path, kind, node_path, children[, level]) of all nodes. children: mask of a branch's nibbles.

    A leaf hangs one nibble below its deepest branch; a branch that is more than one nibble below the branch above it
    has an extension in between.
    """
    leaves = keys.select(F.col(trie).alias("trie"), F.col(path).alias("path")).distinct().withColumn("value", F.lit(b""))
    return reduced(leaves, hashes=False, keep=True)[1].drop("ref", *([] if levels else ["level"])).withColumnRenamed("trie", trie)


def roots(leaves: DataFrame, with_nodes: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """((trie, root), nodes): root hashes of all tries among leaves (trie, path, value: the encoded leaf value).

    with_nodes: also a table (trie, path, ref) of every branch's reference. Tries without leaves have no row.
    """
    tops, nodes = reduced(leaves, keep=with_nodes)
    return tops, nodes.where("kind = 'branch'").select("trie", "path", "ref") if with_nodes else None


def visit(accounts: DataFrame, storage: DataFrame | None = None) -> DataFrame:
    """Every node of the state's trie and of all storage tries, with what a visitor of the tries sees.

    (is_storage, account: of a storage trie, path, level: branches and extensions above it, kind, node_path, children,
    hash: null where a parent holds the node itself, encoded: the node where it does).
    """
    storage_roots, inner = reduced(storage_leaves(storage), keep=True) if storage is not None else (None, None)
    nodes = reduced(account_leaves(accounts, storage_roots), keep=True)[1]
    nodes = nodes if inner is None else nodes.unionByName(inner)
    hashed = (F.octet_length("ref") == 33) & F.hex("ref").startswith("A0")
    return nodes.select(
        (F.col("trie") != "").alias("is_storage"), F.col("trie").alias("account"), "path", "level", "kind", "node_path", "children",
        F.when(hashed, F.substr("ref", F.lit(2))).alias("hash"), F.when(~hashed, F.col("ref")).alias("encoded"),
    )


def reduced_parts(leaves: DataFrame, level: int = STEP) -> DataFrame:
    """(trie, prefix, path, leaf, node): one stored item for each (trie, first nibbles). What ``updated_parts`` and ``roots_of_parts`` start from."""
    found = _reduced(leaves.select("trie", "path", F.lit(True).alias("leaf"), F.col("value").alias("node")), level, True, False)
    return stored(found.select("trie", F.substr(F.col("path"), F.lit(1), F.lit(level)).alias("prefix"), "path", "leaf", "node"), "parts")


def updated_parts(parts: DataFrame, leaves: DataFrame, changed: DataFrame, level: int = STEP) -> DataFrame:
    """parts after keys (trie, path) have changed, been added or deleted. leaves: all that live now; only those of changed parts are read and hashed."""
    prefix = F.substr(F.col("path"), F.lit(1), F.lit(level))
    return replaced_parts(parts, leaves, stored(changed.select("trie", prefix.alias("prefix")).distinct(), "touched"), level)


def replaced_parts(parts: DataFrame, leaves: DataFrame, touched: DataFrame, level: int = STEP) -> DataFrame:
    """parts, of which those touched (trie, prefix) are made anew from leaves, or go if they have none any more."""
    prefix = F.substr(F.col("path"), F.lit(1), F.lit(level))
    own = leaves.withColumn("prefix", prefix).join(touched, ["trie", "prefix"], "left_semi").drop("prefix")
    return stored(parts.join(touched, ["trie", "prefix"], "left_anti").unionByName(reduced_parts(own, level)), "parts")


def roots_of_parts(parts: DataFrame) -> DataFrame:
    """(trie, root) from parts."""
    return stored(_reduced(parts, 0, True, False), "roots").where("kind = 'root'").select("trie", F.col("ref").alias("root"))


def storage_leaves(storage: DataFrame) -> DataFrame:
    """Leaves of storage tries from (account, slot, value); empty values are no leaves."""
    return storage.where(F.octet_length("value") > 0).select(F.col("account").alias("trie"), F.col("slot").alias("path"), rlp.byte_string(F.col("value")).alias("value"))


def account_leaves(accounts: DataFrame, storage_roots: DataFrame | None = None, trie: str = "") -> DataFrame:
    """Leaves of the state trie from (account, balance, nonce[, code_hash]). Accounts without storage have the empty root.

    Storage of accounts that don't exist takes no part.
    """
    code = F.col("code_hash") if "code_hash" in accounts.columns else F.lit(None).cast("binary")
    rows = accounts
    root = F.lit(None).cast("binary")
    if storage_roots is not None:
        rows = accounts.join(storage_roots.select(F.col("trie").alias("account"), F.col("root").alias("_root")), "account", "left")
        root = F.col("_root")
    return rows.select(F.lit(trie).alias("trie"), F.col("account").alias("path"), rlp.account_items(F.col("balance"), F.col("nonce"), root, code).alias("_items")).select("trie", "path", rlp.list_of(F.col("_items")).alias("value"))


def state_root(accounts: DataFrame, storage: DataFrame | None = None) -> DataFrame:
    """One row (root): the state's root hash with all storage roots computed anew; of the empty state, the empty root."""
    storage_roots = roots(storage_leaves(storage))[0] if storage is not None else None
    found = roots(account_leaves(accounts, storage_roots))[0]
    return found.agg(F.coalesce(F.max("root"), F.lit(EMPTY_TREE)).alias("root"))


def subtrie_root(leaves: DataFrame, prefix: str) -> DataFrame:
    """(trie, root) of what lies under a path."""
    return roots(leaves.where(F.col("path").startswith(prefix.upper())).withColumn("path", F.substr(F.col("path"), F.lit(len(prefix) + 1))))[0]


def promote_proofs(branches: DataFrame, persisted: DataFrame) -> DataFrame:
    """Proof branches all of whose children are persisted with the hash that the branch has for them.

    branches: (path, children: array of (nibble, hash)); persisted: (path, hash). Goes bottom up, as a promoted branch
    (with its ``hash``) counts as persisted for the one above.
    """
    depths = [r[0] for r in branches.select(F.length("path")).distinct().orderBy(F.desc(F.length("path"))).collect()]
    done = persisted.select("path", "hash")
    promoted = None
    for d in depths:
        own = branches.where(F.length("path") == d)
        needed = own.select("path", F.explode("children").alias("c")).select("path", F.concat("path", F.col("c.nibble")).alias("child"), F.col("c.hash").alias("wanted"))
        met = needed.join(done.select(F.col("path").alias("child"), F.col("hash").alias("have")), "child", "left").groupBy("path").agg(F.bool_and(F.coalesce(F.col("have") == F.col("wanted"), F.lit(False))).alias("ok"))
        new = own.join(met.where("ok").select("path"), "path", "left_semi").select("path", "hash")
        done = done.unionByName(new)
        promoted = new if promoted is None else promoted.unionByName(new)
    return promoted if promoted is not None else branches.select("path", "hash").limit(0)


def is_boundary(value: Column) -> Column:
    """34 bytes that begin with two zero bytes mark a hash beyond the synced range."""
    return (F.octet_length(value) == 34) & (F.hex(F.substr(value, F.lit(1), F.lit(2))) == "0000")


def boundary(hash_: Column) -> Column:
    return F.concat(F.lit(b"\x00\x00"), hash_)


def boundary_value(value: Column) -> Column:
    """The hash of a boundary value; null for other values."""
    return F.when(is_boundary(value), F.substr(value, F.lit(3)))


def storage_root(storage: DataFrame, account: str) -> DataFrame:
    """(trie, root) of one account's storage."""
    return roots(storage_leaves(storage.where(F.col("account") == account.upper())))[0]


def storage_subtrie_root(storage: DataFrame, account: str, prefix: str) -> DataFrame:
    """(trie, root) of what lies under a path of one account's storage."""
    return subtrie_root(storage_leaves(storage.where(F.col("account") == account.upper())), prefix)


_SYNCED = ["account", "path", "kind", "node_path", "children", "memo", "ref", "persist"]


def synced_branches(branches: DataFrame) -> DataFrame:
    """Node rows of branches known by their children's hashes alone.

    branches: (account: zero or empty for the state, path, children: array of (nibble, hash), persist: false for proofs).
    """
    sorted_ = F.array_sort("children")
    items = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.concat(F.lit("A0"), F.hex(F.try_element_at(F.map_from_entries("children"), F.hex(i)))), F.lit("80")))
    rows = branches.withColumn("_node", rlp.list_of(F.unhex(F.concat(F.array_join(items, ""), F.lit("80")))))
    nibble = lambda c: F.conv(c["nibble"], 16, 10).cast("tinyint")
    return rows.select(
        "account", "path", F.lit("branch").alias("kind"), F.lit("").alias("node_path"),
        F.aggregate("children", F.lit(0), lambda m, c: m.bitwiseOR(F.pow(F.lit(2), nibble(c)).cast("int"))).alias("children"),
        F.map_from_entries(F.transform(sorted_, lambda c: F.struct(nibble(c).alias("k"), c["hash"].alias("v")))).alias("memo"),
        keccak256(F.col("_node")).alias("ref"), "persist",
    )


def synced_extensions(extensions: DataFrame) -> DataFrame:
    """Node rows of extensions: (account, path, node_path, child: the hash of the branch below, persist)."""
    rows = extensions.withColumn("_node", rlp.extension_node(F.col("node_path"), F.concat(F.lit(b"\xa0"), F.col("child"))))
    return rows.select("account", "path", F.lit("extension").alias("kind"), "node_path", F.lit(0).alias("children"), F.lit(None).cast("map<tinyint,binary>").alias("memo"), keccak256(F.col("_node")).alias("ref"), "persist")


def synced_leaves(leaves: DataFrame) -> DataFrame:
    """Node rows of leaves: (account, path, node_path). Their values are state rows of their own; leaves always persist."""
    return leaves.select("account", "path", F.lit("leaf").alias("kind"), "node_path", F.lit(0).alias("children"), F.lit(None).cast("map<tinyint,binary>").alias("memo"), F.lit(None).cast("binary").alias("ref"), F.lit(True).alias("persist"))


def persisted(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys (account, path, hash or null) with ``persisted``: whether a node that isn't just a proof is there, with that hash if one is given.

    At the full length of a key there is never one: that is the leaf's value.
    """
    there = nodes.where("persist").groupBy("account", "path").agg(F.collect_set("ref").alias("_refs"))
    met = keys.join(there, ["account", "path"], "left")
    same = F.col("hash").isNull() | F.array_contains("_refs", F.coalesce("hash", F.lit(b"")))
    return met.select(*keys.columns, (F.col("_refs").isNotNull() & (F.length("path") < PATH_LENGTH) & same).alias("persisted"))
