"""Reads and folds over a forkable op log.

ops:    block_hash, seq, op (0 set, 1 destroy, 2 prefix delete), type, account, slot, value, entry_type
blocks: number, state_hash, parent_hash
base:   account, slot, type, value (a folded snapshot)

An empty or null value is a tombstone. A destroy is a barrier: it hides all that is older for its account, but not
what the same block sets after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ACCOUNT

SET, DESTROY, PREFIX_DELETE = 0, 1, 2
#: Entry types that a committed block keeps, and the one that reaches a snapshot.
PERSISTENT, CACHED, USE_ONCE, PROOF = 0, 1, 2, 3
KEY = ["account", "type", "slot"]


#: Unfinalized blocks whose links may be walked on the driver; longer logs are walked by a recursive query.
WALKED = 100_000


def ancestors(blocks: DataFrame, head: str, walked: int = WALKED) -> DataFrame:
    """(state_hash, number, depth) from head (depth 0) down to the last known parent. Raises on an unknown head.

    Finality bounds the number of unfinalized blocks, so their links (two hashes and a number each) are counted, gathered
    and walked; beyond the bound one recursive SQL query walks them.
    """
    spark = blocks.sparkSession
    blocks = blocks.select("state_hash", "parent_hash", F.col("number").cast("long").alias("number"))
    rows = blocks.limit(walked + 1).collect()
    if len(rows) <= walked:
        parents = {r.state_hash: r for r in rows}
        if head not in parents:
            raise KeyError(f"unknown block {head}")
        path, at = [], head
        while at in parents and len(path) <= len(parents):
            path.append((at, parents[at].number, len(path)))
            at = parents[at].parent_hash
        return spark.createDataFrame(path, "state_hash string, number long, depth int")
    if blocks.where(F.col("state_hash") == head).limit(1).count() == 0:
        raise KeyError(f"unknown block {head}")
    blocks.createOrReplaceTempView("_chain_blocks")
    return spark.sql(
        """WITH RECURSIVE chain(state_hash, parent_hash, number, depth) MAX RECURSION LEVEL 1000000 AS (
          SELECT state_hash, parent_hash, number, 0 FROM _chain_blocks WHERE state_hash = :head
          UNION ALL
          SELECT b.state_hash, b.parent_hash, b.number, c.depth + 1 FROM chain c JOIN _chain_blocks b ON b.state_hash = c.parent_hash
        ) SELECT state_hash, number, depth FROM chain""",
        args={"head": head},
    )


#: Parts that the rows of one account (or prefix) are dealt into when facts about it are joined to them.
SALTS = 16
#: The layer of a folded snapshot: below all blocks.
BELOW = -(1 << 62)


def _with_facts(rows: DataFrame, facts: DataFrame, on: dict[str, Column]) -> DataFrame:
    """rows left-joined with facts (unique by their columns named in on). Facts are repeated SALTS times, so that no key's rows are one task's."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumns({"_salt": F.pmod(F.xxhash64("account", "slot"), F.lit(SALTS)).cast("int"), **{f"_on_{k}": v for k, v in on.items()}})
    met = dealt.join(salted.withColumnsRenamed({k: f"_on_{k}" for k in on}), [*(f"_on_{k}" for k in on), "_salt"], "left")
    return met.drop("_salt", *(f"_on_{k}" for k in on))


def _owner() -> Column:
    return F.when(F.col("type") == ACCOUNT, F.lit("")).otherwise(F.col("account"))


def _visible(sets: DataFrame, ops: DataFrame) -> DataFrame:
    """(account, type, slot, value, layer) of the keys whose last set nothing hides.

    sets: KEY, value, layer, seq; ops: destroys and prefix deletes with their layer (blocks from old to new) and seq. A
    destroy hides what is older in its account, by layer and seq; a prefix delete what lower layers have under it. What
    hides a key's last set hides all its sets, so that one aggregation by key goes before all joins.
    """
    last = sets.groupBy(*KEY).agg(F.max(F.struct("layer", "seq", "value")).alias("_top"))
    destroys = ops.where(F.col("op") == DESTROY).groupBy("account").agg(F.max(F.struct("layer", "seq")).alias("_destroyed"))
    last = _with_facts(last, destroys.withColumnRenamed("account", "of"), {"of": F.col("account")})
    left = last.where(F.col("_destroyed").isNull() | (F.struct("_top.layer", "_top.seq") > F.col("_destroyed"))).drop("_destroyed")
    deletes = ops.where(F.col("op") == PREFIX_DELETE).select(_owner().alias("of"), F.col("slot").alias("prefix"), F.col("type").alias("kind"), "layer")
    deletes = deletes.groupBy("of", "prefix", "kind").agg(F.max("layer").alias("_deleted"))
    path = F.when(F.col("type") == ACCOUNT, F.col("account")).otherwise(F.col("slot"))
    for n in _lengths(deletes):
        own = deletes.where(F.length("prefix") == n)
        met = _with_facts(left, own, {"of": _owner(), "prefix": F.substr(path, F.lit(1), F.lit(n)), "kind": F.col("type")})
        left = met.where(F.col("_deleted").isNull() | (F.col("_top.layer") >= F.col("_deleted"))).drop("_deleted")
    return left.select(*KEY, F.col("_top.value").alias("value"), F.col("_top.layer").alias("layer"))


def _lengths(prefixes: DataFrame) -> list[int]:
    """The lengths of the prefixes: at most 65 of them reach the driver."""
    return sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())


def overlay(ops: DataFrame, chain: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Visible (account, type, slot, value, depth) at the chain's head: the nearest block that sets a key wins.

    chain: (state_hash, depth), broadcast by Spark as it is small. base, if given, lies below all blocks. Destroys and
    prefix deletes hide what lies below them. Tombstones of storage and accounts are left out of the result.
    """
    depth = chain.select(F.col("state_hash").alias("block_hash"), (-F.col("depth").cast("long")).alias("layer"))
    placed = ops.join(depth, "block_hash")
    sets = placed.where(F.col("op") == SET).select(*KEY, "value", "layer", F.col("seq").cast("long").alias("seq"))
    if base is not None:
        sets = sets.unionByName(base.select(*KEY, "value", F.lit(BELOW).alias("layer"), F.lit(0).cast("long").alias("seq")))
    seen = _visible(sets, placed.withColumn("seq", F.col("seq").cast("long")))
    return seen.where(F.octet_length("value") > 0).select(*KEY, "value", (-F.col("layer")).alias("depth"))


def fold(base: DataFrame, ops: DataFrame) -> DataFrame:
    """The next snapshot: prefix deletes, destroys and the last persistent sets over a base; only live keys stay.

    ops of several blocks have a ``number`` that orders the blocks, and seq orders the ops of a block; folding them at once
    gives what folding block by block does. Base and sets meet in one aggregation by key.
    """
    number = F.col("number").cast("long") if "number" in ops.columns else F.lit(0).cast("long")
    placed = ops.withColumns({"layer": number, "seq": F.col("seq").cast("long")})
    sets = placed.where((F.col("op") == SET) & (F.col("entry_type") == PERSISTENT)).select(*KEY, "value", "layer", "seq")
    below = base.select(*KEY, "value", F.lit(BELOW).alias("layer"), F.lit(BELOW).alias("seq"))
    return _visible(sets.unionByName(below), placed).where(F.octet_length("value") > 0).select(*KEY, "value")


def discard(state: DataFrame, keys: DataFrame) -> DataFrame:
    """A block's entries without the given (account, type, slot): removed as if never set, not as tombstones."""
    return remove_keys(state, keys, KEY)


def merged(target: DataFrame, entries: DataFrame, entry_types: tuple[int, ...] = (PERSISTENT,)) -> DataFrame:
    """target (account, type, slot, value, entry_type) with the entries of the given types laid over it."""
    over = entries.where(F.col("entry_type").isin(*entry_types))
    both = target.select(*KEY, "value", "entry_type", F.lit(0).alias("layer")).unionByName(over.select(*KEY, "value", "entry_type", F.lit(1).alias("layer")))
    return both.groupBy(*KEY).agg(F.max(F.struct("layer", "value", "entry_type")).alias("t")).select(*KEY, "t.value", "t.entry_type")


def may_lie_in(keys: DataFrame, ops: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """keys (account, slot) with ``may_contain``: whether blocks may set them or destroy their account. False means no block needs a look."""
    from . import filters

    own, account = F.xxhash64("account", "slot"), F.xxhash64("account")
    added = ops.select(F.when(F.col("op") == SET, own).otherwise(account).alias("_h"))
    return filters.may_contain(keys, filters.build(added, F.col("_h"), bits), own, account, bits=bits)


def fell_through(keys: DataFrame, ops: DataFrame) -> DataFrame:
    """One row (reads, to_base): how many of the asked keys (account, slot) no block answers, so that the snapshot is read."""
    sets = ops.where(F.col("op") == SET).select("account", "slot").distinct().withColumn("_set", F.lit(True))
    gone = ops.where(F.col("op") == DESTROY).select("account").distinct().withColumn("_gone", F.lit(True))
    asked = keys.join(sets, ["account", "slot"], "left").join(gone, "account", "left")
    return asked.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("_set").isNull() & F.col("_gone").isNull()).alias("to_base"))


def remove_prefixes(state: DataFrame, prefixes: DataFrame) -> DataFrame:
    """State without the keys under any (account, prefix, type). For accounts the prefix is of the account's own path.

    A theta join in equi-join form: the prefixes' few lengths are gathered (there are at most 65), and each key offers
    its beginnings of these lengths.
    """
    path = F.when(F.col("type") == ACCOUNT, F.col("account")).otherwise(F.col("slot"))
    gone = prefixes.select(_owner().alias("_o"), F.col("prefix").alias("_p"), F.col("type").alias("_t")).distinct()
    for n in _lengths(prefixes):
        own = gone.where(F.length("_p") == n)
        state = state.join(own, (_owner() == F.col("_o")) & (F.substr(path, F.lit(1), F.lit(n)) == F.col("_p")) & (F.col("type") == F.col("_t")), "left_anti")
    return state


def describe(ops: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(account, type, slot, deleted): the keys a block changes, of those that a predicate over the op's columns admits."""
    own = ops.where(F.col("op") == SET)
    own = own if predicate is None else own.where(predicate)
    return own.groupBy(*KEY).agg((F.coalesce(F.octet_length(F.max_by("value", "seq")), F.lit(0)) == 0).alias("deleted"))


def visit(ops: DataFrame, kind: int) -> DataFrame:
    """The last change of each key of one type (accounts, storage or trie nodes): (account, slot, value)."""
    return ops.where((F.col("op") == SET) & (F.col("type") == kind)).groupBy("account", "slot").agg(F.max_by("value", "seq").alias("value"))


def lookup(state: DataFrame, keys: DataFrame, on: list[str], default: bytes = b"") -> DataFrame:
    """Values of the asked keys; a missing key reads as default."""
    return keys.join(state.select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def contains(keys: DataFrame, state: DataFrame, on: list[str]) -> DataFrame:
    """The asked keys that the state has."""
    return keys.join(state, on, "left_semi")


def remove_keys(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The state without the given keys."""
    return state.join(keys, on, "left_anti")


def net_changes(ops: DataFrame) -> DataFrame:
    """(account, slot, deleted): what the last op of each touched slot did."""
    return ops.groupBy("account", "slot").agg((F.octet_length(F.coalesce(F.max_by("value", "seq"), F.lit(b""))) == 0).alias("deleted"))


def touched(ops: DataFrame) -> DataFrame:
    """Per account: slots set and slots deleted."""
    net = net_changes(ops)
    return net.groupBy("account").agg(F.array_sort(F.collect_set(F.when(~F.col("deleted"), F.col("slot")))).alias("set_slots"), F.array_sort(F.collect_set(F.when(F.col("deleted"), F.col("slot")))).alias("deleted_slots"))
