"""Registered queries of the state engine over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chain import Chain
from .functions import bits, memo, paths, rlp
from .functions.keccak import EMPTY_CODE, EMPTY_TREE, ROTATIONS, ROUNDS, keccak256
from .operators import filters, overlay, stats, tries
from .plans import adapters
from .sources import importer
from .sources.shared import shared_dir, stored
from .sources.snapshots import SnapshotStore

#: The block (a day of events) at which as-of reads look.
AS_OF = "2024-01-15"
#: Events of this type destroy their account.
DESTROYS = "error"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str = "value") -> F.Column:
    return F.decode(F.col(value), "UTF-8")


def _numbered(ops: DataFrame) -> DataFrame:
    """Ops of day blocks with the block's number: days since 1970."""
    return ops.withColumn("number", F.unix_date(F.to_date("block_hash")).cast("long"))


_OPS_SQL = """WITH ops AS (
  SELECT strftime(ts, '%Y-%m-%d') AS block_hash, event_id AS seq, event_type = 'error' AS destroys, upper(sha256(CAST(user_id AS VARCHAR))) AS account,
    upper(hex(encode(event_type))) AS slot, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM events)
"""


def _live_sql(where: str = "true") -> str:
    """(account, slot, value) that live after the ops that a condition admits: the last set of each slot, unless its account was destroyed since."""
    return f"""(SELECT account, slot, arg_max(value, seq) FILTER (NOT destroys) AS value FROM (
  SELECT *, max(seq) FILTER (destroys) OVER (PARTITION BY account) AS gone FROM ops WHERE {where}
) WHERE NOT destroys AND (gone IS NULL OR seq > gone) GROUP BY account, slot)"""


# --- reads over blocks -------------------------------------------------------------------------------------------


@_query(_OPS_SQL + f"SELECT account, arg_max(value, seq) AS value, max(seq) AS seq FROM (SELECT *, max(seq) FILTER (destroys) OVER (PARTITION BY account) AS gone FROM ops WHERE block_hash <= '{AS_OF}') WHERE NOT destroys AND (gone IS NULL OR seq > gone) GROUP BY account")
def account_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each account as of a block, if nothing destroyed it since: the filter reaches the scan, and one aggregation gives the winner."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS).where(F.col("block_hash") <= AS_OF)
    set_ = F.when(F.col("op") == overlay.SET, F.struct("seq", _text().alias("value")))
    last = ops.groupBy("account").agg(F.max(set_).alias("s"), F.max(F.when(F.col("op") == overlay.DESTROY, F.col("seq"))).alias("gone"))
    return last.where("s is not null and (gone is null or s.seq > gone)").select("account", "s.value", "s.seq")


@_query(_OPS_SQL + "SELECT * FROM " + _live_sql())
def storage_latest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS)
    empty = ops.select(*overlay.KEY, "value").limit(0)
    return overlay.fold(empty, ops).select("account", "slot", _text().alias("value"))


@_query(
    _OPS_SQL
    + f"""SELECT account, slot, value FROM {_live_sql(f"NOT (NOT destroys AND starts_with(slot, '7') AND block_hash < '{AS_OF}' AND account IN (SELECT upper(sha256(CAST(user_id AS VARCHAR))) FROM events WHERE user_id % 3 = 0))")}"""
)
def prefix_delete_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks folded at once; the block of AS_OF deletes by prefix what the blocks before it have set in every third account."""
    events = _table(spark, sf_dir, "events")
    ops = _numbered(adapters.event_ops(events, DESTROYS))
    deletes = events.where("user_id % 3 = 0").select("user_id").distinct().select(
        F.lit(AS_OF).alias("block_hash"), F.lit(0).cast("long").alias("seq"), F.lit(overlay.PREFIX_DELETE).alias("op"), F.lit(paths.STORAGE).alias("type"),
        adapters.hashed_key(F.col("user_id")).alias("account"), F.lit("7").alias("slot"), F.lit(None).cast("binary").alias("value"), F.lit(0).alias("entry_type"),
    )
    both = ops.unionByName(_numbered(deletes), allowMissingColumns=True)
    return overlay.fold(ops.select(*overlay.KEY, "value").limit(0), both).select("account", "slot", _text().alias("value"))


@_query(_OPS_SQL + ", d AS (SELECT account, max(seq) AS last FROM ops WHERE destroys GROUP BY account) SELECT account, slot, arg_max(value, seq) AS value FROM ops LEFT JOIN d USING (account) WHERE NOT destroys AND (last IS NULL OR seq > last) GROUP BY account, slot")
def destroy_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay read at the newest block: nearest block first, and destroyed accounts hide what lies below."""
    events = _table(spark, sf_dir, "events")
    blocks = adapters.day_blocks(events)
    head = blocks.agg(F.max("state_hash")).first()[0] or ""
    ops = adapters.event_ops(events, DESTROYS)
    if not head:
        return ops.select("account", "slot", _text().alias("value")).limit(0)
    return overlay.overlay(ops, overlay.ancestors(blocks, head)).select("account", "slot", _text().alias("value"))


@_query(
    _OPS_SQL
    + f""", base AS (SELECT account, slot, arg_max(value, seq) AS value FROM ops WHERE NOT destroys AND block_hash <= '{AS_OF}' GROUP BY account, slot),
  d AS (SELECT account, max(seq) AS last FROM ops WHERE destroys AND block_hash > '{AS_OF}' GROUP BY account),
  s AS (SELECT account, slot, arg_max(value, seq) AS value FROM ops LEFT JOIN d USING (account) WHERE NOT destroys AND block_hash > '{AS_OF}' AND (last IS NULL OR seq > last) GROUP BY account, slot)
SELECT account, slot, coalesce(s.value, b.value) AS value FROM (SELECT * FROM base WHERE account NOT IN (SELECT account FROM d)) b FULL JOIN s USING (account, slot)"""
)
def overlay_on_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after a snapshot, read over it."""
    events = _table(spark, sf_dir, "events")
    ops = adapters.event_ops(events, DESTROYS)
    old = ops.where((F.col("block_hash") <= AS_OF) & (F.col("op") == overlay.SET))
    base = overlay.fold(old.select(*overlay.KEY, "value").limit(0), old)
    new = ops.where(F.col("block_hash") > AS_OF)
    blocks = adapters.day_blocks(events).where(F.col("state_hash") > AS_OF)
    chain = blocks.select("state_hash", (F.lit(1 << 30) - F.col("number")).alias("depth"))
    return overlay.overlay(new, chain, base).select("account", "slot", _text().alias("value"))


@_query(_OPS_SQL + "SELECT account, slot, arg_max(CAST(value AS DOUBLE) < 10, seq) AS deleted FROM ops WHERE NOT destroys GROUP BY account, slot")
def set_delete_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last op of each slot did; values under 10 stand for deletes."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS).where(F.col("op") == overlay.SET)
    return overlay.net_changes(ops.withColumn("value", F.when(_text().cast("double") >= 10, F.col("value"))))


@_query(
    _OPS_SQL
    + """, n AS (SELECT account, slot, arg_max(CAST(value AS DOUBLE) < 10, seq) AS deleted FROM ops WHERE NOT destroys GROUP BY account, slot)
SELECT account, coalesce(string_agg(slot, ',' ORDER BY slot) FILTER (NOT deleted), '') AS set_slots, coalesce(string_agg(slot, ',' ORDER BY slot) FILTER (deleted), '') AS deleted_slots FROM n GROUP BY account"""
)
def touched_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS).where(F.col("op") == overlay.SET)
    found = overlay.touched(ops.withColumn("value", F.when(_text().cast("double") >= 10, F.col("value"))))
    return found.select("account", F.array_join("set_slots", ",").alias("set_slots"), F.array_join("deleted_slots", ",").alias("deleted_slots"))


@_query(
    """WITH RECURSIVE b AS (SELECT d AS state_hash, lag(d) OVER (ORDER BY d) AS parent, row_number() OVER (ORDER BY d) AS number FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events)),
chain AS (SELECT state_hash, parent, number, 0 AS depth FROM b WHERE state_hash = (SELECT max(state_hash) FROM b)
  UNION ALL SELECT b.state_hash, b.parent, b.number, chain.depth + 1 FROM chain JOIN b ON b.state_hash = chain.parent)
SELECT state_hash, number, CAST(depth AS INTEGER) AS depth FROM chain"""
)
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = adapters.day_blocks(_table(spark, sf_dir, "events"))
    return overlay.ancestors(blocks, blocks.agg(F.max("state_hash")).first()[0])


@_query("SELECT d AS state_hash, row_number() OVER (ORDER BY d DESC) AS age FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events) ORDER BY d DESC LIMIT 16")
def retention_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that a history of 16 keeps (its length is what bounds the window)."""
    blocks = adapters.day_blocks(_table(spark, sf_dir, "events"))
    top = blocks.agg(F.max("number").alias("top"))
    return blocks.join(top).where(F.col("number") > F.col("top") - 16).select("state_hash", (F.col("top") - F.col("number") + 1).alias("age"))


# --- keyed entries -----------------------------------------------------------------------------------------------

_KEYED = "(SELECT c_custkey AS id, upper(sha256(CAST(c_custkey AS VARCHAR))) AS path, c_name || '|' || c_mktsegment AS value FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.keyed(_table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment")


@_query(f"SELECT id, path, value FROM {_KEYED} WHERE starts_with(path, 'A') OR starts_with(path, '1F')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    return paths.under(rows, "A").unionByName(paths.under(rows, "1F")).select("id", "path", _text().alias("value"))


@_query("""WITH p AS (SELECT DISTINCT substr(upper(sha256(CAST(n_nationkey AS VARCHAR))), 1, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END) AS prefix FROM nation),
k AS (SELECT o_orderkey AS id, upper(sha256(CAST(o_orderkey AS VARCHAR))) AS slot FROM orders)
SELECT id, slot FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(slot, prefix))""")
def prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account's storage without the slots under any of many prefixes."""
    state = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), adapters.hashed_key(F.col("o_orderkey")).alias("slot"), F.lit("00").alias("account"), F.lit(paths.STORAGE).alias("type"))
    size = F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(3)
    prefixes = _table(spark, sf_dir, "nation").select(F.lit("00").alias("account"), F.substr(adapters.hashed_key(F.col("n_nationkey")), F.lit(1), size).alias("prefix"), F.lit(paths.STORAGE).alias("type"))
    return overlay.remove_prefixes(state, prefixes).select("id", "slot")


@_query(f"SELECT id, path FROM {_KEYED} WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 300000)")
def remove_keys_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.remove_keys(_customers(spark, sf_dir), adapters.keyed(_table(spark, sf_dir, "orders").where("o_totalprice >= 300000"), "o_custkey").select("path"), ["path"]).select("id", "path")


@_query(f"SELECT id, path FROM {_KEYED} WHERE id IN (SELECT o_custkey FROM orders)")
def contains_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.contains(_customers(spark, sf_dir), adapters.keyed(_table(spark, sf_dir, "orders"), "o_custkey").select("path"), ["path"]).select("id", "path")


@_query(f"SELECT p_partkey AS id, coalesce(k.value, '') AS value FROM part LEFT JOIN {_KEYED} k ON k.id = p_partkey")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched point reads; keys that aren't there read as empty."""
    keys = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), adapters.hashed_key(F.col("p_partkey")).alias("path"))
    return overlay.lookup(_customers(spark, sf_dir), keys, ["path"]).select("id", _text().alias("value"))


@_query(f"SELECT substr(path, 1, 1) AS nibble, count(*) AS entries FROM {_KEYED} GROUP BY 1")
def nibble_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_nibble(_customers(spark, sf_dir))


@_query(f"SELECT substr(path, 1, 1) AS bucket, CAST(sum(32 + octet_length(encode(value)) + 4) AS BIGINT) AS bytes FROM {_KEYED} GROUP BY 1")
def nibble_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_by(_customers(spark, sf_dir), F.substring("path", 1, 1))


@_query("SELECT l_orderkey % 97 AS bucket, CAST(sum(32 + octet_length(encode(l_returnflag || '|' || l_linestatus)) + 4) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def bucket_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("value"), F.lit("0" * 64).alias("path"), "l_orderkey")
    return stats.size_by(rows, F.col("l_orderkey") % 97)


@_query("SELECT CASE WHEN substr(path, 1, 1) BETWEEN '0' AND '7' THEN 'half_low' ELSE 'half_high' END AS selector, count(*) AS n FROM " + _KEYED + " GROUP BY 1")
def nibble_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    return rows.groupBy(F.when(paths.selected(F.col("path"), "half_low"), "half_low").otherwise("half_high").alias("selector")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT coalesce(o_orderstatus, 'all') AS scope, coalesce(o_orderpriority, 'all') AS kind, CAST(coalesce(month(o_orderdate), -1) AS INTEGER) AS depth, count(*) AS nodes, quantile_cont(floor(o_totalprice), 0.5) AS p50
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority, month(o_orderdate))""")
def depth_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("kind"), F.month("o_orderdate").alias("depth"), F.floor("o_totalprice").cast("double").alias("used"))
    return stats.by_depth(rows).select(F.coalesce("scope", F.lit("all")).alias("scope"), F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("depth", F.lit(-1)).alias("depth"), "nodes", "p50")


@_query("""WITH v AS (SELECT DISTINCT o_custkey AS v FROM orders), g AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM v),
r AS (SELECT min(v) AS first, max(v) AS last FROM g GROUP BY g), p AS (SELECT last, unnest(range(first, last + 1, 64)) AS first FROM r)
SELECT first, least(last - first + 1, 64) AS length FROM p""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.consecutive(_table(spark, sf_dir, "orders"), "o_custkey", 64)


@_query("""SELECT p_partkey * 7 AS q, (SELECT max(o_custkey) FROM orders WHERE o_custkey <= p_partkey * 7) AS v FROM part""")
def predecessor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries_ = _table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("q"))
    return stats.highest_not_above(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("v")), queries_, "v", "q")


@_query("SELECT min(i) AS gap FROM range(0, (SELECT max(o_custkey) + 2 FROM orders)) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders)")
def first_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_gap(_table(spark, sf_dir, "orders"), "o_custkey")


@_query("SELECT c_custkey AS address FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def integrity_unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocated but neither reachable nor abandoned."""
    of = lambda table, column: _table(spark, sf_dir, table).select(F.col(column).alias("address"))
    pending = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("address"))
    return stats.unreached(of("customer", "c_custkey"), pending, of("supplier", "s_suppkey"))


# --- filters -----------------------------------------------------------------------------------------------------


@_query("SELECT 0 AS missed, count(*) AS added FROM (SELECT DISTINCT c_custkey FROM customer)")
def filter_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    hash_ = F.xxhash64("path")
    found = filters.may_contain(rows, filters.build(rows, hash_), hash_)
    return found.agg(F.sum((~F.col("may_contain")).cast("int")).cast("int").alias("missed"), F.count(F.lit(1)).alias("added"))


@_query("SELECT 0 AS missed, (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS added")
def filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two filters has the keys of both; members are asked for by either of two hashes."""
    hash_ = F.xxhash64("path")
    a, b = _customers(spark, sf_dir).select("path"), adapters.keyed(_table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") + 1_000_000_000), "k").select("path")
    both = filters.union(filters.build(a, hash_), filters.build(b, hash_))
    found = filters.may_contain(a.unionByName(b), both, F.xxhash64(F.lit("absent")), hash_)
    return found.agg(F.sum((~F.col("may_contain")).cast("int")).cast("int").alias("missed"), F.count(F.lit(1)).alias("added"))


@_query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def filter_added_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return filters.added_first(rows, F.xxhash64("user_id"), "event_id").where("was_new").select("user_id", "event_id")


# --- scalar functions --------------------------------------------------------------------------------------------


@_query(
    f"""SELECT id, substr(path, 4) AS tail, substr(path, 1, 5) AS head, substr(path, 3, 7) AS middle, CAST(instr('0123456789ABCDEF', substr(path, 3, 1)) - 1 AS INTEGER) AS nibble, path || 'F' AS longer,
  regexp_full_match(substr(path, 1, 1), '0*') AS zero, '0x' || lower(path) AS hex, CASE WHEN path LIKE '00%' THEN substr(path, 3, 4) ELSE substr(path, 1, 4) END AS trimmed FROM {_KEYED}"""
)
def nibble_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    key = F.unhex(p)
    trimmed = F.hex(bits.without_leading_zeros(key))
    return _customers(spark, sf_dir).select(
        "id", paths.slice_path(p, 3).alias("tail"), paths.slice_path(p, 0, 5).alias("head"), paths.slice_path(p, 2, 7).alias("middle"), paths.nibble_at(p, 2).alias("nibble"),
        paths.append(p, F.lit("F")).alias("longer"), paths.only_zeroes(paths.slice_path(p, 0, 1)).alias("zero"), bits.to_hex(key).alias("hex"),
        F.when(p.startswith("0000"), F.substring(p, 3, 4)).otherwise(F.substr(trimmed, F.lit(1), F.lit(4))).alias("trimmed"),
    )


@_query(
    f"""WITH k AS (SELECT id, path, lag(path) OVER (ORDER BY path) AS before FROM {_KEYED}),
e AS (SELECT id, path, before, unnest(range(1, 65)) AS i FROM k WHERE before IS NOT NULL)
SELECT id, CAST(coalesce(max(i) FILTER (substr(path, 1, i) = substr(before, 1, i)), 0) AS INTEGER) AS shared FROM e GROUP BY id"""
)
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tries.neighbours(_customers(spark, sf_dir).select("id", "path", F.lit("").alias("trie")))
    return rows.where("left >= 0").select("id", F.col("left").alias("shared"))


@_query("""SELECT p_partkey AS id, CAST(m AS INTEGER) AS mask, CAST(bit_count(m) AS INTEGER) AS members, CAST(length(bin(m)) - 1 AS INTEGER) AS largest,
  CAST(bit_count((m & -m) - 1) AS INTEGER) AS smallest, CAST(bit_count(m & 255) AS INTEGER) AS up_to_7, (m >> 3) & 1 = 1 AS has_3
FROM (SELECT p_partkey, CAST(p_partkey * 7919 % 65535 + 1 AS BIGINT) AS m FROM part)""")
def bitset_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 65535 + 1).cast("int").alias("mask"))
    m = F.col("mask")
    return rows.select("id", "mask", bits.count(m).alias("members"), bits.largest(m).alias("largest"), bits.smallest(m).alias("smallest"), bits.rank(m, F.lit(7)).alias("up_to_7"), bits.has(m, F.lit(3)).alias("has_3"))


@_query("""WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders), h AS (SELECT o_orderkey, n, printf('%X', n) AS x FROM v),
e AS (SELECT o_orderkey, n, CASE WHEN length(x) % 2 = 1 THEN '0' || x ELSE x END AS x FROM h)
SELECT o_orderkey AS id, CASE WHEN n = 0 THEN '80' WHEN n < 128 THEN x ELSE printf('%X', 128 + length(x) // 2) || x END AS encoded, lpad(CASE WHEN n = 0 THEN '' ELSE x END, 64, '0') AS decoded FROM e""")
def rlp_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RLP of prices in cents, and back."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), rlp.integer(bits.uint_bytes(F.round(F.col("o_totalprice") * 100).cast("long"))).alias("e"))
    return rows.select("id", F.hex("e").alias("encoded"), F.hex(rlp.decode_integer(F.col("e"))).alias("decoded"))


@_query("""SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS account, CAST(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) AS BIGINT) AS balance, CAST(c_nationkey AS BIGINT) AS nonce, true AS plain FROM customer""")
def account_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts through their compact encoding and back."""
    rows = adapters.accounts_of(_table(spark, sf_dir, "customer"))
    none = F.lit(None).cast("binary")
    coded = rows.select("account", rlp.account_bytes(F.col("balance"), F.col("nonce"), none, none).alias("data"))
    number = lambda c: F.conv(F.substr(F.hex(c), F.lit(50)), 16, 10).cast("long")
    return coded.select("account", rlp.account_from_bytes(F.col("data")).alias("a"), (F.octet_length("data") < 20).alias("plain")).select("account", number("a.balance").alias("balance"), number("a.nonce").alias("nonce"), "plain")


@_query(f"SELECT id, CASE WHEN id % 2 = 0 THEN '20' || substr(path, 1, 8) ELSE '3' || substr(path, 1, 7) END AS leaf, CASE WHEN id % 2 = 0 THEN '00' || substr(path, 1, 8) ELSE '1' || substr(path, 1, 7) END AS extension FROM {_KEYED}")
def hex_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substr(F.col("path"), F.lit(1), F.when(F.col("id") % 2 == 0, 8).otherwise(7))
    return _customers(spark, sf_dir).select("id", F.hex(rlp.hex_prefix(part, True)).alias("leaf"), F.hex(rlp.hex_prefix(part, False)).alias("extension"))


@_query("""SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS account, '' AS slot, CAST(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) AS BIGINT) AS number, CAST(c_nationkey AS BIGINT) AS nonce FROM customer
UNION ALL SELECT upper(sha256(CAST(o_custkey AS VARCHAR))), upper(sha256(CAST(o_orderkey AS VARCHAR))), CAST(round(o_totalprice * 100) AS BIGINT), CAST(-1 AS BIGINT) FROM orders""")
def import_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account and storage leaves of a trie, as another node has them, taken into the state and read."""
    accounts = tries.account_leaves(adapters.accounts_of(_table(spark, sf_dir, "customer")))
    storage = adapters.storage_of(_table(spark, sf_dir, "orders")).select(F.concat("account", "slot").alias("path"), rlp.byte_string(F.col("value")).alias("value"))
    state = importer.import_leaves(accounts.select("path", "value").unionByName(storage))
    number = lambda c: F.conv(F.substr(F.hex(bits.padded32(c)), F.lit(50)), 16, 10).cast("long")
    read = state.select("account", "slot", "type", "value", F.when(F.col("type") == paths.ACCOUNT, rlp.account_from_bytes(F.col("value"))).alias("a"))
    return read.select("account", "slot", number(F.coalesce("a.balance", "value")).alias("number"), F.when(F.col("type") == paths.ACCOUNT, number(F.col("a.nonce"))).otherwise(F.lit(-1)).alias("nonce"))


@_query("""WITH m AS (SELECT n_regionkey, n_nationkey % 16 AS k, max(sha256(n_name)) AS v FROM nation GROUP BY ALL),
i AS (SELECT n_regionkey, k, v FROM m WHERE k NOT IN (3, 5) UNION ALL SELECT DISTINCT n_regionkey, 3, 'new' FROM m)
SELECT n_regionkey AS region, string_agg(k || '=' || v, ',' ORDER BY k) AS memo, CAST(sum(1 << k) AS INTEGER) AS children, true AS has_3 FROM i GROUP BY 1""")
def child_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child hashes of a branch: one inserted, one deleted."""
    each = _table(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 16).cast("tinyint").alias("k")).agg(F.max(F.sha2("n_name", 256)).alias("v"))
    built = each.groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("k", F.encode("v", "UTF-8").alias("v")))).alias("m"))
    m = memo.delete(memo.insert(F.col("m"), F.lit(3), F.lit(b"new")), F.lit(5))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.decode(e["value"], "UTF-8"))), ",")
    return built.select("region", text.alias("memo"), memo.children(m).alias("children"), memo.exists(m, F.lit(3)).alias("has_3"))


def _keccak_sql(rows: str, given: str = "") -> str:
    """SQL for (id, digest) of rows (id, h: upper-case hex of at most 135 bytes): the permutation as list expressions, a row for each round."""
    place, turn = [0] * 25, [0] * 25
    for (x, y), n in ROTATIONS.items():
        at = y + 5 * ((2 * x + 3 * y) % 5)
        place[at], turn[at] = x + 5 * y + 1, n
    constants = ", ".join(str(int(c)) for c in ROUNDS)
    lane = "array_to_string([substr({0}, 15 - 2 * k, 2) for k in range(0, 8)], '')"
    return f"""WITH RECURSIVE {given} kin AS (SELECT id, rpad(h || '01', 270, '0') || '80' AS h FROM {rows}),
s AS (SELECT id, 0 AS round, [CASE WHEN i < 17 THEN CAST('0x' || {lane.format('substr(h, 16 * i + 1, 16)')} AS UBIGINT) ELSE 0::UBIGINT END for i in range(0, 25)] AS a FROM kin
UNION ALL SELECT id, round + 1, [CASE WHEN i = 1 THEN xor(v, ([{constants}]::UBIGINT[])[round + 1]) ELSE v END for v, i in x] FROM (
  SELECT id, round, [xor(b[i + 1], ~b[i - i % 5 + (i + 1) % 5 + 1] & b[i - i % 5 + (i + 2) % 5 + 1]) for i in range(0, 25)] AS x FROM (
    SELECT id, round, [CASE WHEN r[j + 1] = 0 THEN t[p[j + 1]] ELSE ((t[p[j + 1]] & ((1::UBIGINT << (64 - r[j + 1])) - 1)) << r[j + 1]) | (t[p[j + 1]] >> (64 - r[j + 1])) END for j in range(0, 25)] AS b FROM (
      SELECT id, round, {place} AS p, {turn}::UBIGINT[] AS r, [xor(a[i + 1], d[i % 5 + 1]) for i in range(0, 25)] AS t FROM (
        SELECT id, round, a, [xor(c[(x + 4) % 5 + 1], ((c[(x + 1) % 5 + 1] & 9223372036854775807::UBIGINT) << 1) | (c[(x + 1) % 5 + 1] >> 63)) for x in range(0, 5)] AS d FROM (
          SELECT id, round, a, [xor(xor(xor(xor(a[x + 1], a[x + 6]), a[x + 11]), a[x + 16]), a[x + 21]) for x in range(0, 5)] AS c FROM s WHERE round < 24))))))
SELECT id, array_to_string([{lane.format("printf('%016X', a[i])")} for i in range(1, 5)], '') AS digest FROM s WHERE round = 24"""


_EVEN = "CASE WHEN length({0}) % 2 = 1 THEN '0' || {0} ELSE {0} END"


@_query(_keccak_sql(f"(SELECT id, hex(encode(value)) AS h FROM {_KEYED})"))
def keccak_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("id", F.hex(keccak256(F.col("value"))).alias("digest"))


# --- tries -------------------------------------------------------------------------------------------------------

_LCP = """WITH k AS (SELECT DISTINCT trie, path FROM (SELECT 'customer' AS trie, upper(sha256(CAST(c_custkey AS VARCHAR))) AS path FROM customer UNION ALL SELECT 'part', upper(sha256(CAST(p_partkey AS VARCHAR))) FROM part)),
p AS (SELECT trie, substr(path, 1, d) AS prefix, d, count(*) AS n, count(DISTINCT substr(path, d + 1, 1)) AS kids, sum(DISTINCT 1 << (instr('0123456789ABCDEF', substr(path, d + 1, 1)) - 1)) AS mask FROM k, range(0, 24) r(d) GROUP BY ALL),
b AS (SELECT trie, prefix, d, CAST(mask AS INTEGER) AS mask FROM p WHERE kids > 1),
l AS (SELECT k.trie, k.path, max(b.d) AS d FROM k JOIN b ON b.trie = k.trie AND starts_with(k.path, b.prefix) GROUP BY ALL),
u AS (SELECT x.trie, x.prefix, x.d, coalesce(max(y.d), -1) AS up FROM b x LEFT JOIN b y ON y.trie = x.trie AND y.d < x.d AND starts_with(x.prefix, y.prefix) GROUP BY ALL)
"""


def _two_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key: _table(spark, sf_dir, name).select(F.lit(name).alias("trie"), adapters.hashed_key(F.col(key)).alias("path"))
    return of("customer", "c_custkey").unionByName(of("part", "p_partkey"))


@_query(
    _LCP
    + """SELECT trie, substr(path, 1, d + 1) AS path, 'leaf' AS kind, substr(path, d + 2) AS node_path, 0 AS children FROM l
UNION ALL SELECT trie, prefix, 'branch', '', mask FROM b
UNION ALL SELECT trie, substr(prefix, 1, up + 1), 'extension', substr(prefix, up + 2), 0 FROM u WHERE d > up + 1"""
)
def trie_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.structure(_two_tries(spark, sf_dir))


@_query(
    _LCP
    + """SELECT trie, kind, depth, count(*) AS nodes FROM (SELECT trie, 'leaf' AS kind, d + 1 AS depth FROM l UNION ALL SELECT trie, 'branch', d FROM b UNION ALL SELECT trie, 'extension', up + 1 FROM u WHERE d > up + 1) GROUP BY ALL"""
)
def trie_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.structure(_two_tries(spark, sf_dir)).groupBy("trie", "kind", F.length("path").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("nodes"))


_LEAF_SQL = f"""b AS (SELECT c_custkey AS id, upper(sha256(CAST(c_custkey AS VARCHAR))) AS path, c_nationkey AS nonce, CASE WHEN c_acctbal <= 0 THEN '' ELSE printf('%X', CAST(round(c_acctbal * 100) AS BIGINT)) END AS x FROM customer),
e AS (SELECT id, path, CASE WHEN nonce = 0 THEN '80' ELSE printf('%02X', nonce) END AS n, {_EVEN.format('x')} AS x FROM b),
a AS (SELECT id, path, n || CASE WHEN x = '' THEN '80' WHEN length(x) = 2 AND x < '80' THEN x ELSE printf('%02X', 128 + length(x) // 2) || x END || 'A0{EMPTY_TREE.hex().upper()}A0{EMPTY_CODE.hex().upper()}' AS body FROM e),
v AS (SELECT id, 'A120' || path || 'B8' || printf('%02X', length(body) // 2 + 2) || 'F8' || printf('%02X', length(body) // 2) || body AS body FROM a),"""


@_query(_keccak_sql("(SELECT id, 'F8' || printf('%02X', length(body) // 2) || body AS h FROM v)", _LEAF_SQL))
def account_leaf_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of each account's own state: its leaf is the whole trie."""
    accounts = adapters.accounts_of(_table(spark, sf_dir, "customer"))
    ids = _customers(spark, sf_dir).select("id", "path")
    leaves = tries.account_leaves(accounts).withColumn("trie", F.col("path"))
    return tries.roots(leaves)[0].join(ids, F.col("trie") == F.col("path")).select("id", F.hex("root").alias("digest"))


@_query(
    _keccak_sql(
        "(SELECT id, printf('%02X', 192 + length(body) // 2) || body AS h FROM v)",
        f"""one AS (SELECT o_custkey AS id, min(o_orderkey) AS o, CAST(round(min(o_totalprice) * 100) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT id, o, printf('%X', n) AS x FROM one), r AS (SELECT id, o, {_EVEN.format('x')} AS x FROM x),
v AS (SELECT id, 'A120' || upper(sha256(CAST(o AS VARCHAR))) || printf('%02X', 128 + length(x) // 2 + 1) || printf('%02X', 128 + length(x) // 2) || x AS body FROM r),""",
    )
)
def single_slot_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage roots of the customers that have one order."""
    orders = _table(spark, sf_dir, "orders")
    one = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("o_custkey").alias("id"), adapters.hashed_key(F.col("o_custkey")).alias("trie"))
    return tries.roots(tries.storage_leaves(adapters.storage_of(orders)))[0].join(one, "trie").select("id", F.hex("root").alias("digest"))


@_query()
def state_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's root over customers as accounts and their orders as storage."""
    accounts = adapters.accounts_of(_table(spark, sf_dir, "customer"))
    return tries.state_root(accounts, adapters.storage_of(_table(spark, sf_dir, "orders"))).select(F.hex("root").alias("root"))


@_query()
def storage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tries.roots(tries.storage_leaves(adapters.storage_of(_table(spark, sf_dir, "orders"))))[0]
    return found.select(F.col("trie").alias("account"), F.hex("root").alias("root"))


@_query()
def subtrie_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = tries.account_leaves(adapters.accounts_of(_table(spark, sf_dir, "customer")))
    return tries.subtrie_root(accounts, "A").select(F.hex("root").alias("root"))


@_query("""WITH h AS (SELECT substr(upper(sha256(CAST(c_custkey AS VARCHAR))), 1, 2) AS path, min(c_custkey) AS id FROM customer GROUP BY 1),
want AS (SELECT path, sha256('h' || path) AS wanted, CASE WHEN id % 5 = 0 THEN '' ELSE sha256('h' || path) END AS have FROM h),
one AS (SELECT substr(path, 1, 1) AS path, bool_and(wanted = have) AS ok FROM want GROUP BY 1)
SELECT path, sha256('h' || path) AS hash FROM one WHERE ok UNION ALL SELECT '', sha256('h') FROM one HAVING bool_and(ok)""")
def proof_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof branches at depth 0 and 1 over persisted nodes at depth 2, some of which are missing their hash."""
    digest = lambda p: F.sha2(F.concat(F.lit("h"), p), 256)
    nodes = _customers(spark, sf_dir).groupBy(F.substring("path", 1, 2).alias("path")).agg(F.min("id").alias("id"))
    persisted = nodes.where("id % 5 != 0").select("path", digest(F.col("path")).alias("hash"))
    child = lambda p: F.collect_list(F.struct(F.substr(p, F.length(p), F.lit(1)).alias("nibble"), digest(p).alias("hash")))
    ones = nodes.groupBy(F.substring("path", 1, 1).alias("p")).agg(child(F.col("path")).alias("children"))
    top = ones.groupBy(F.lit("").alias("q")).agg(child(F.col("p")).alias("children"))
    branches = ones.select(F.col("p").alias("path"), digest(F.col("p")).alias("hash"), "children").unionByName(top.select(F.col("q").alias("path"), digest(F.col("q")).alias("hash"), "children"))
    return tries.promote_proofs(branches, persisted)


# --- versions and streams ----------------------------------------------------------------------------------------


@_query(_OPS_SQL + f"SELECT CAST(1 AS BIGINT) AS block_number, account, slot, value FROM {_live_sql(f"block_hash <= '{AS_OF}'")} UNION ALL SELECT 2, account, slot, value FROM {_live_sql()}")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions committed one after the other, and all retained versions read back."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS)
    store = SnapshotStore(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", history=2)
    for number, part in ((1, ops.where(F.col("block_hash") <= AS_OF)), (2, ops.where(F.col("block_hash") > AS_OF))):
        base = store.read_head().select(*overlay.KEY, "value")
        store.commit(overlay.fold(base, part), number, f"state-{number}")
    return store.read_all().select("block_number", "account", "slot", _text().alias("value"))


_CUTS = ("2024-01-08", AS_OF, "2024-01-22")


@_query(
    _OPS_SQL
    + ", v AS ("
    + " UNION ALL ".join(f"SELECT {i} AS n, * FROM {_live_sql(f"block_hash <= '{cut}'")}" for i, cut in enumerate(_CUTS, 1))
    + """), s AS (SELECT n, count(*) AS entries, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS VARCHAR) AS total FROM v GROUP BY n), a AS (SELECT * FROM (VALUES ('state-1', false, 3), ('state-2', true, 2), ('state-3', true, 3), ('state-9', false, 3)) t(asked, known, n))
SELECT asked, known, CAST(coalesce(entries, 0) AS BIGINT) AS entries, total FROM a LEFT JOIN s USING (n)"""
)
def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions in a history of two, asked for by hash: what isn't retained reads as the latest."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS)
    store = SnapshotStore(spark, f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}", history=2)
    below = ""
    for i, cut in enumerate(_CUTS, 1):
        part = ops.where((F.col("block_hash") > below) & (F.col("block_hash") <= cut))
        store.commit(overlay.fold(store.read_head().select(*overlay.KEY, "value"), part), i, f"state-{i}", flush=i != 2)
        below = cut
    store.flush()
    every = []
    for asked in ("state-1", "state-2", "state-3", "state-9"):
        found = store.read(asked) if store.has_state(asked) else store.read_or_latest(asked)
        every.append(found.agg(F.lit(asked).alias("asked"), F.lit(store.has_state(asked)).alias("known"), F.count(F.lit(1)).alias("entries"), F.sum(_text().cast("decimal(18,2)")).cast("string").alias("total")))
    return reduce(DataFrame.unionByName, every)


@_query("SELECT 'h' || i AS state_hash, CAST(i AS BIGINT) AS block_number, i - 2 AS batch FROM range(3, 7) t(i)")
def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six commits to a store that keeps four."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", history=4)
    state = _customers(spark, sf_dir).limit(1).select(F.col("path").alias("account"), F.lit("").alias("slot"), F.lit(paths.ACCOUNT).alias("type"), "value")
    for n in range(1, 7):
        store.commit(state, n, f"h{n}", flush=n % 2 == 0)
    found = store.read_all().groupBy("state_hash", "block_number", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("state_hash", "block_number", (F.col("batch_id") - 2).alias("batch"))


@_query(_OPS_SQL + "SELECT * FROM " + _live_sql())
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log as a stream of files, folded into snapshots micro-batch by micro-batch; blocks lie across files."""
    from .streaming.folding import fold_stream

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _numbered(adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS)).repartition(4).write.parquet(f"{path}/ops")
    source = spark.readStream.schema(spark.read.parquet(f"{path}/ops").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
    store = SnapshotStore(spark, f"{path}/store", history=4)
    fold_stream(source, store, f"{path}/checkpoint").awaitTermination()
    return store.read_latest().select("account", "slot", _text().alias("value"))


# --- chains ------------------------------------------------------------------------------------------------------

_ACCOUNTS_SQL = "a AS (SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS account, greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) AS balance, c_nationkey AS nation FROM customer)"


def _account_ops(rows: DataFrame, balance: F.Column) -> DataFrame:
    """Ops that set accounts (account, nonce); seq by hash, as keys don't repeat."""
    none = F.lit(None).cast("binary")
    value = rlp.account_bytes(balance, F.col("nonce"), none, none)
    return rows.select(F.xxhash64("account").alias("seq"), F.lit(overlay.SET).alias("op"), F.lit(paths.ACCOUNT).alias("type"), "account", F.lit("").alias("slot"), value.alias("value"), F.lit(overlay.PERSISTENT).alias("entry_type"))


def _chain(spark: SparkSession, sf_dir: str) -> Chain:
    """Customers' accounts in b1; b2 destroys those of nation 0, b3 sets those of nation 1 anew; the fork f2 on b1 empties those of nation 2."""
    rows = adapters.accounts_of(_table(spark, sf_dir, "customer")).join(_table(spark, sf_dir, "customer").select(adapters.hashed_key(F.col("c_custkey")).alias("account"), "c_nationkey"), "account")
    chain = Chain(SnapshotStore(spark, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}", history=2))
    block = chain.start()
    block.apply(_account_ops(rows, F.col("balance")))
    block.commit(1, "b1")
    block = chain.start("b1")
    gone = rows.where("c_nationkey = 0")
    block.apply(_account_ops(gone, F.col("balance")).withColumns({"op": F.lit(overlay.DESTROY), "value": F.lit(None).cast("binary")}))
    block.commit(2, "b2")
    block = chain.start("b2")
    block.apply(_account_ops(rows.where("c_nationkey = 1"), F.lit(b"\x07")))
    block.commit(3, "b3")
    fork = chain.start("b1")
    fork.apply(_account_ops(rows.where("c_nationkey = 3"), F.lit(b"")))
    fork.reset()
    fork.apply(_account_ops(rows.where("c_nationkey = 2"), F.lit(b"")))
    fork.commit(2, "f2")
    return chain


def _number(c: F.Column) -> F.Column:
    return F.conv(F.substr(F.hex(c), F.lit(50)), 16, 10).cast("long")


_STATES_SQL = _ACCOUNTS_SQL + """, v AS (SELECT 'b1' AS state, * FROM a UNION ALL SELECT 'b2', * FROM a WHERE nation <> 0 UNION ALL SELECT 'b3', account, CASE nation WHEN 1 THEN 7 ELSE balance END, nation FROM a WHERE nation <> 0
  UNION ALL SELECT 'f2', account, CASE nation WHEN 2 THEN 0 ELSE balance END, nation FROM a)"""


@_query("WITH " + _STATES_SQL + " SELECT state, count(*) AS accounts, CAST(sum(balance) AS BIGINT) AS balance, CAST(sum(nation) AS BIGINT) AS nonce, true AS known FROM v GROUP BY state")
def chain_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks, one of them on a fork, read through views at their hashes."""
    chain = _chain(spark, sf_dir)
    each = [chain.view(h).accounts().agg(F.lit(h).alias("state"), F.count(F.lit(1)).alias("accounts"), F.sum(_number(F.col("balance"))).alias("balance"), F.sum(_number(F.col("nonce"))).alias("nonce"), F.lit(chain.has_state(h)).alias("known")) for h in ("b1", "b2", "b3", "f2")]
    return reduce(DataFrame.unionByName, each)


@_query(
    "WITH " + _STATES_SQL + """, asked AS (SELECT t.h AS state, a.account FROM a, (VALUES ('b1'), ('b2'), ('b3'), ('f2'), ('none')) t(h)),
known AS (SELECT * FROM v WHERE state IN ('b1', 'b2', 'b3'))
SELECT asked.state, asked.account, coalesce(known.balance, 0) AS balance, CAST(coalesce(known.nation, 0) AS BIGINT) AS nonce FROM asked LEFT JOIN known USING (state, account)"""
)
def accessor_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts at (state hash, account) after b2 is final: versions, the block above them, and hashes that went or never were."""
    chain = _chain(spark, sf_dir)
    chain.finalize("b2")
    states = spark.createDataFrame([(h,) for h in ("b1", "b2", "b3", "f2", "none")], "state_hash string")
    keys = states.join(_customers(spark, sf_dir).select(F.col("path").alias("account")))
    read = chain.accessor().accounts(keys)
    return read.select(F.col("state_hash").alias("state"), "account", _number(F.col("balance")).alias("balance"), _number(F.col("nonce")).alias("nonce"))


@_query("SELECT h AS state_hash, known FROM (VALUES ('b1', true), ('b2', true), ('b3', true), ('f2', false), ('none', false)) t(h, known)")
def finalized_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which states are known after b2 is final: the fork of its height went."""
    chain = _chain(spark, sf_dir)
    chain.finalize("b2")
    chain.finalize("b1")
    return spark.createDataFrame([(h, chain.has_state(h)) for h in ("b1", "b2", "b3", "f2", "none")], "state_hash string, known boolean")


@_query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_custkey, o_orderstatus FROM orders), b AS (SELECT *, seq // (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) FROM n) + 1 AS number FROM n),
top AS (SELECT max(number) AS top FROM b), l AS (SELECT 'latest' AS state, o_custkey, o_orderstatus, arg_max(o_orderkey, seq) AS v FROM b, top WHERE number <= top - 4 GROUP BY ALL UNION ALL SELECT 'head', o_custkey, o_orderstatus, arg_max(o_orderkey, seq) FROM b GROUP BY ALL)
SELECT state, upper(sha256(CAST(o_custkey AS VARCHAR))) AS account, upper(hex(o_orderstatus)) AS slot, CAST(v AS VARCHAR) AS value FROM l""")
def bulk_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded in about eight blocks; the last four of them stay above the version."""
    orders = _table(spark, sf_dir, "orders")
    n = orders.count()
    ids = orders.select("o_orderkey").sort("o_orderkey")
    # seq without gaps: ranges of the key are numbered by the counts of the ranges before
    parted = stored(ids.withColumn("p", F.spark_partition_id()), "ids")
    sizes = parted.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    first = sizes.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    seq = parted.join(first, "p").withColumn("seq", F.col("first") + F.row_number().over(Window.partitionBy("p").orderBy("o_orderkey")) - 1)
    ops = orders.join(seq, "o_orderkey").select(
        F.lit("").alias("block_hash"), F.col("seq").cast("long").alias("seq"), F.lit(overlay.SET).alias("op"), F.lit(paths.STORAGE).alias("type"), adapters.hashed_key(F.col("o_custkey")).alias("account"),
        F.hex(F.encode("o_orderstatus", "UTF-8")).alias("slot"), F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("value"), F.lit(overlay.PERSISTENT).alias("entry_type"),
    )
    chain = Chain(SnapshotStore(spark, f"{shared_dir(spark)}/import-{uuid.uuid4().hex}", history=2))
    top = chain.import_blocks(ops, -(-n // 8), lag=4)
    of = lambda state, view: view.storage().select(F.lit(state).alias("state"), "account", "slot", _text().alias("value"))
    return of("latest", chain.latest()).unionByName(of("head", chain.view(f"import-{top}")))


@_query(_OPS_SQL + f"SELECT account, slot, arg_max(value, seq) = '' AS deleted FROM ops WHERE block_hash = '{AS_OF}' AND NOT destroys AND slot LIKE '7%' GROUP BY account, slot")
def describe_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that one block changes, of those a predicate admits."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS).where(F.col("block_hash") == AS_OF)
    return overlay.describe(ops, F.col("slot").startswith("7")).select("account", "slot", "deleted")


@_query(_OPS_SQL + f"SELECT account, slot, arg_max(value, seq) AS value FROM ops WHERE block_hash = '{AS_OF}' AND NOT destroys GROUP BY account, slot")
def visit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS).where(F.col("block_hash") == AS_OF)
    return overlay.visit(ops, paths.STORAGE).select("account", "slot", _text().alias("value"))


@_query(_OPS_SQL + f""", k AS (SELECT DISTINCT account, slot FROM ops WHERE NOT destroys), s AS (SELECT DISTINCT account, slot FROM ops WHERE block_hash > '{AS_OF}' AND NOT destroys), d AS (SELECT DISTINCT account FROM ops WHERE block_hash > '{AS_OF}' AND destroys)
SELECT count(*) AS reads, count(*) FILTER ((account, slot) NOT IN (SELECT (account, slot) FROM s) AND account NOT IN (SELECT account FROM d)) AS to_base, CAST(0 AS BIGINT) AS missed FROM k""")
def reads_to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that no block since AS_OF answers, and reads that the blocks' filter would wrongly keep from them."""
    ops = adapters.event_ops(_table(spark, sf_dir, "events"), DESTROYS)
    keys = ops.where(F.col("op") == overlay.SET).select("account", "slot").distinct()
    new = ops.where(F.col("block_hash") > AS_OF)
    held = new.where(F.col("op") == overlay.SET).select("account", "slot").distinct()
    missed = overlay.may_lie_in(keys, new).join(held, ["account", "slot"]).agg(F.count_if(~F.col("may_contain")).alias("missed"))
    return overlay.fell_through(keys, new).join(missed)


@_query("""WITH t AS (SELECT c_custkey AS id, c_name AS v FROM customer WHERE c_custkey % 2 = 0), e AS (SELECT c_custkey AS id, c_mktsegment AS v, c_custkey % 4 AS kind FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT id, coalesce(e.v, t.v) AS v FROM t FULL JOIN (SELECT * FROM e WHERE kind IN (0, 1)) e USING (id))
SELECT upper(sha256(CAST(id AS VARCHAR))) AS slot, v AS value FROM m WHERE id % 5 <> 0""")
def merged_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overlay laid over another, of two entry types only, and keys removed as if never set."""
    customers = _table(spark, sf_dir, "customer")
    of = lambda rows, value, kind: rows.select(F.lit("00").alias("account"), F.lit(paths.STORAGE).alias("type"), adapters.hashed_key(F.col("c_custkey")).alias("slot"), F.encode(value, "UTF-8").alias("value"), kind.alias("entry_type"))
    target = of(customers.where("c_custkey % 2 = 0"), "c_name", F.lit(overlay.PERSISTENT))
    entries = of(customers.where("c_custkey % 3 = 0"), "c_mktsegment", (F.col("c_custkey") % 4).cast("int"))
    both = overlay.merged(target, entries, (overlay.PERSISTENT, overlay.CACHED))
    return overlay.discard(both, of(customers.where("c_custkey % 5 = 0"), "c_name", F.lit(0))).select("slot", _text().alias("value"))


# --- more of keys, encodings and statistics ----------------------------------------------------------------------


@_query(f"""WITH s AS (SELECT * FROM (VALUES ('all', 0, 15), ('half_low', 0, 7), ('half_high', 8, 15), ('q0', 0, 3), ('q1', 4, 7), ('q2', 8, 11), ('q3', 12, 15)) t(selector, low, high)), k AS (SELECT instr('0123456789ABCDEF', substr(path, 1, 1)) - 1 AS n FROM {_KEYED})
SELECT selector, count(n) AS entries, count(n) > 0 AS found FROM s LEFT JOIN k ON n BETWEEN low AND high GROUP BY selector""")
def nibble_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    each = [rows.where(paths.selected(F.col("path"), name)).agg(F.lit(name).alias("selector"), F.count(F.lit(1)).alias("entries")).join(stats.has_any(rows, name)) for name in paths.SELECTORS]
    return reduce(DataFrame.unionByName, each)


@_query(f"SELECT parts, CAST((instr('0123456789ABCDEF', substr(path, 1, 1)) - 1) % parts AS INTEGER) AS part, count(*) AS entries FROM {_KEYED}, (VALUES (1), (2), (4), (8)) t(parts) GROUP BY ALL")
def nibble_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries dealt into 1, 2, 4 and 8 parts by their first nibble."""
    rows = _customers(spark, sf_dir)
    return reduce(DataFrame.unionByName, [stats.partitioned(rows, n).groupBy(F.lit(n).alias("parts"), "part").agg(F.count(F.lit(1)).alias("entries")) for n in (1, 2, 4, 8)])


@_query(f"""SELECT 0 + length(prefix) AS depth, prefix, count(*) AS entries, CAST(sum(32 + octet_length(encode(value)) + 4) AS BIGINT) AS bytes FROM (SELECT value, substr(path, 1, CAST(d AS INTEGER)) AS prefix FROM {_KEYED}, range(0, 4) t(d)) GROUP BY prefix""")
def bucket_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket of up to three nibbles with its prefix, entries and bytes."""
    return stats.buckets(_customers(spark, sf_dir), 3).select(F.length("prefix").cast("long").alias("depth"), "prefix", "entries", "bytes")


@_query(f"""WITH p AS (SELECT 'data' AS kind, 2 AS depth, substr(path, 1, 2) AS b, sum(36 + octet_length(encode(value))) AS used FROM {_KEYED} GROUP BY ALL UNION ALL SELECT 'bottom', 3, substr(path, 1, 3), sum(36 + octet_length(encode(value))) FROM {_KEYED} GROUP BY ALL)
SELECT kind, depth, least(CAST(floor(used * 100 / 4096.0) AS BIGINT), 99) // 10 * 10 AS percent, count(*) AS parts FROM p GROUP BY ALL""")
def used_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full parts of 4096 bytes are, for parts by two nibbles (data) and by three (bottom)."""
    rows = _customers(spark, sf_dir)
    used = lambda kind, depth: rows.groupBy(F.substring("path", 1, depth)).agg(F.sum(stats.entry_size()).alias("used")).select(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), "used")
    parts = used("data", 2).unionByName(used("bottom", 3))
    return stats.used_histogram(parts, 4096, "data").unionByName(stats.used_histogram(parts, 4096, "bottom"))


@_query(f"SELECT CAST(sum(36 + octet_length(encode(value))) AS DOUBLE) / 1048576 AS used FROM {_KEYED}")
def utilisation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.utilisation(_customers(spark, sf_dir), 1 << 20)


@_query("""SELECT event_type AS name, arg_max(value, event_id) AS last, count(*) AS samples, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS highest FROM events GROUP BY event_type""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge, counter and histogram figures of samples."""
    from .plans import metrics

    samples = _table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), F.col("event_type").alias("name"), "value")
    return metrics.summary(samples).drop("total").withColumn("p99", F.round("p99", 6))


@_query(
    f"""SELECT id, substr(path, 1, 6) AS parsed, substr(path, 4) AS from_second, substr(path, 1, 2) AS pair, substr(path, 1, 1) AS one, lower(path) AS key, id % 3 = 0 OR (id % 3 = 2 AND id % 2 = 0) AS in_state, CASE WHEN id % 2 = 0 THEN lower(path) END AS boundary, id % 2 = 0 AS boundary_leaf,
  '0000' || lower(path) AS marker, true AS is_marker, lower(path) AS marked, CAST((id * 7919 % 65535 + 1) AS INTEGER) AS mask, CAST(bit_count(((id * 7919 % 65535 + 1) & -(id * 7919 % 65535 + 1)) - 1) AS INTEGER) AS lowest, CAST(bit_count((~(id * 7919 % 65535 + 1) & -(~(id * 7919 % 65535 + 1))) - 1) AS INTEGER) AS missing FROM {_KEYED}"""
)
def key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from hex, bytes and nibbles, and what tells state keys and hashes beyond a synced range apart."""
    p, i = F.col("path"), F.col("id")
    nibbles = F.array(paths.nibble_at(p, 0), paths.nibble_at(p, 1))
    kind = F.when(i % 3 == 0, paths.ACCOUNT).when(i % 3 == 1, paths.STORAGE).otherwise(paths.MERKLE)
    long_path = F.when(i % 2 == 0, F.concat(F.lit("ABC"), p)).otherwise(p)
    marker = tries.boundary(paths.to_key(p))
    mask = (i * 7919 % 65535 + 1).cast("int")
    return _customers(spark, sf_dir).select(
        "id", paths.parse(F.concat(F.lit("0x"), F.lower(F.substring(p, 1, 6)))).alias("parsed"), paths.from_key(F.unhex(p), 3).alias("from_second"), paths.from_nibbles(nibbles).alias("pair"), paths.single(paths.nibble_at(p, 0)).alias("one"),
        F.lower(F.hex(paths.to_key(p))).alias("key"), paths.is_state(kind, F.when(i % 2 == 0, F.substring(p, 1, 5)).otherwise(p)).alias("in_state"), F.lower(F.hex(paths.boundary_hash(long_path))).alias("boundary"), paths.is_boundary_leaf(long_path).alias("boundary_leaf"),
        F.lower(F.hex(marker)).alias("marker"), tries.is_boundary(marker).alias("is_marker"), F.lower(F.hex(tries.boundary_value(marker))).alias("marked"), mask.alias("mask"), bits.smallest(mask).alias("lowest"), bits.smallest_missing(mask).alias("missing"),
    )


@_query("SELECT count(DISTINCT c_custkey) AS keys, count(DISTINCT c_custkey) AS hashes, count(DISTINCT c_custkey) AS path_hashes FROM customer")
def key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of keys for filters: as many as there are keys."""
    rows = _customers(spark, sf_dir)
    return rows.agg(F.count_distinct("path").alias("keys"), F.count_distinct(paths.key_hash(F.col("path"), F.lit(0), F.lit(""))).alias("hashes"), F.count_distinct(F.xxhash64("path")).alias("path_hashes"))


@_query("""WITH v AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS n, o_orderkey % 300 AS size FROM orders), h AS (SELECT *, (length(printf('%X', n)) + 1) // 2 AS width FROM v)
SELECT id, CAST(CASE WHEN n < 128 THEN 1 ELSE width + 1 END AS INTEGER) AS of_integer, CAST(CASE WHEN size = 0 OR size = 1 THEN 1 WHEN size < 56 THEN size + 1 WHEN size < 256 THEN size + 2 ELSE size + 3 END AS INTEGER) AS of_bytes,
  CAST(CASE WHEN size < 56 THEN size + 1 WHEN size < 256 THEN size + 2 ELSE size + 3 END AS INTEGER) AS of_list, CAST(CASE WHEN size < 256 THEN 1 ELSE 2 END AS INTEGER) AS of_length,
  CASE WHEN size < 56 THEN printf('%02X', 192 + size) WHEN size < 256 THEN 'F8' || printf('%02X', size) ELSE 'F9' || printf('%04X', size) END AS list_header FROM h""")
def rlp_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), bits.uint_bytes(F.round(F.col("o_totalprice") * 100).cast("long")).alias("n"), (F.col("o_orderkey") % 300).cast("int").alias("size"))
    filled = F.unhex(F.repeat(F.lit("07"), size))
    return rows.select(
        "id", rlp.length_of_integer(F.col("n")).alias("of_integer"), rlp.length_of(filled).alias("of_bytes"), rlp.length_of_sequence(size).cast("int").alias("of_list"), rlp.length_of_length(size).alias("of_length"),
        F.substr(F.hex(rlp.list_of(filled)), F.lit(1), F.when(size < 56, 2).when(size < 256, 4).otherwise(6)).alias("list_header"),
    )


_RLP_CASES = (("80", "0"), ("05", "5"), ("7F", "127"), ("8180", "128"), ("820400", "1024"), ("", None), ("00", None), ("8105", None), ("820005", None), ("8204", None), ("83010203FF", None), ("A1" + "01" * 33, None), ("C0", None))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', {'NULL' if v is None else chr(39) + v + chr(39)})" for d, v in _RLP_CASES) + ") t(data, value)")
def rlp_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical integers are read; empty, over-long, badly sized and zero-led ones are null."""
    rows = spark.createDataFrame([(d,) for d, _ in _RLP_CASES], "data string")
    return rows.select("data", F.conv(F.substr(F.hex(rlp.decode_integer(F.unhex("data"))), F.lit(50)), 16, 10).alias("value"))


@_query(f"""SELECT id, 'A0' || path AS hash, '80' AS nothing, CASE WHEN id % 2 = 0 THEN '83' || substr(path, 1, 6) ELSE 'A0' || path END AS string, id % 2 = 0 AS is_inline FROM {_KEYED}""")
def rlp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, nothing and strings as items of a list; items below 32 bytes stand for themselves in a parent."""
    key, even = F.unhex("path"), F.col("id") % 2 == 0
    value = F.when(even, F.substr(key, F.lit(1), F.lit(3))).otherwise(key)
    return _customers(spark, sf_dir).select("id", F.hex(rlp.byte_string(key)).alias("hash"), F.hex(rlp.byte_string(F.lit(b""))).alias("nothing"), F.hex(rlp.byte_string(value)).alias("string"), (F.octet_length(rlp.byte_string(value)) < 32).alias("is_inline"))


@_query(f"""SELECT id, CAST(66 + 18 AS INTEGER) AS size, '10' AS first, '01' AS second, lower(path) AS root, lower(path) AS changed_code, CAST(CASE WHEN id % 2 = 0 THEN id ELSE 7 END AS BIGINT) AS nonce FROM {_KEYED}""")
def account_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of large balance in their long form, with fields replaced one by one."""
    rows = _customers(spark, sf_dir)
    big = F.unhex(F.concat(F.lit("FF"), F.repeat(F.lit("01"), F.lit(15))))
    data = rlp.account_bytes(big, F.lit(b"\x07"), F.lit(None).cast("binary"), F.lit(None).cast("binary"))
    rows = rows.withColumn("data", data).withColumn("rooted", rlp.account_with(F.col("data"), storage_root=F.unhex("path")))
    rows = rows.withColumn("coded", rlp.account_with(F.col("rooted"), code_hash=F.unhex("path"))).withColumn("counted", F.when(F.col("id") % 2 == 0, rlp.account_with(F.col("coded"), nonce=bits.uint_bytes(F.col("id")))).otherwise(F.col("coded")))
    read = rows.select("id", "rooted", "coded", rlp.account_from_bytes(F.col("counted")).alias("a"), F.octet_length("data").alias("size"), F.hex(F.substr("data", F.lit(1), F.lit(1))).alias("first"), F.hex(F.substr("data", F.lit(2), F.lit(1))).alias("second"))
    return read.select("id", (F.col("size") + 1).alias("size"), "first", "second", F.lower(F.hex("a.storage_root")).alias("root"), F.lower(F.hex("a.code_hash")).alias("changed_code"), _number(F.col("a.nonce")).alias("nonce"))


@_query("""WITH m AS (SELECT n_regionkey AS region, n_nationkey % 16 AS k, max(sha256(n_name)) AS v FROM nation GROUP BY ALL), r AS (SELECT DISTINCT region FROM m), d AS (SELECT * FROM r, range(0, 4) t(depth)),
c AS (SELECT region, count(*) AS n FROM m GROUP BY region)
SELECT d.region, CAST(depth AS INTEGER) AS depth, (SELECT v FROM m WHERE m.region = d.region AND k = 4 AND depth >= 2) AS fourth, CAST(NULL AS VARCHAR) AS cleared, CASE WHEN depth >= 2 AND NOT (n = 2 AND depth % 2 = 0) THEN n ELSE 0 END AS kept, 'new' AS overwritten FROM d JOIN c USING (region)""")
def memo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child hashes read, cleared, overwritten, and stripped as a snapshot keeps them."""
    each = _table(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 16).cast("tinyint").alias("k")).agg(F.max(F.sha2("n_name", 256)).alias("v"))
    built = each.groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("k", F.encode("v", "UTF-8").alias("v")))).alias("m"))
    rows = built.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("s", memo.stripped(F.col("m"), F.repeat(F.lit("A"), F.col("depth")), F.lit("")))
    text = lambda c: F.decode(c, "UTF-8")
    kept = F.size(F.map_filter("s", lambda _, v: v.isNotNull())).cast("long")
    return rows.select("region", "depth", text(memo.get(F.col("s"), F.lit(4))).alias("fourth"), text(memo.get(memo.clear(F.col("m"), F.lit(4)), F.lit(4))).alias("cleared"), kept.alias("kept"), text(memo.get(memo.insert(F.col("m"), F.lit(4), F.lit(b"new")), F.lit(4))).alias("overwritten"))


# --- tries with known hashes -------------------------------------------------------------------------------------

# Keys, and roots and references that any implementation of the same trie must give.
_K0, _K1, _K2 = "0001020304050607" * 4, "0101020304050607" + "0001020304050607" * 3, "06" * 32
_MAX = 2**256 - 1
_GOLDEN = {
    "key 0": ([(_K0, 13, 23)], "E2533A0A0C4F1DDB72FEB7BFAAD12A83853447DEAAB6F28FA5C443DD2D37C3FB"),
    "key 1": ([(_K1, 17, 29)], "DD358AF6B1D8E875FBA0E585710D054F14DD9D06FA3C8C5F2BAF66F413178F82"),
    "key 2": ([(_K2, 19, 31)], "A654F039A5F9E9F30C89F21555C92F1CB1E739AF11A9E9B12693DEDC6E76F628"),
    "largest balance": ([(_K0, _MAX, 23)], "FC790A3674B6847C609BB91B7014D67B2E70FF0E60F53AC49A8A45F1FECF35A6"),
    "largest nonce": ([(_K0, 13, _MAX)], "F5EC898875FFCF5F161718F09696ABEDA7B77DFB8F8CEBAFA57129F77C8D720B"),
    "two leaves": ([("10" + "00" * 31, 13, 23), ("20" + "00" * 31, 17, 29)], "73130DAA1AE507554A72811C06E28D4FEE671BFE2E1D0CEF828A7FADE54384F9"),
    "extension": ([(_K0, 13, 23), (_K1, 17, 29)], "A624947D9693A5CBA0701897B3A48CB9954C2F4FD54DE36151800EB2C7F6BF50"),
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{root}')" for name, (_, root) in _GOLDEN.items()) + ") t(state, root)")
def golden_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of small states, all tries at once; each state is a trie of its own."""
    rows = [(name, k, b.to_bytes(32, "big"), n.to_bytes(32, "big")) for name, (accounts, _) in _GOLDEN.items() for k, b, n in accounts]
    table = spark.createDataFrame(rows, "state string, account string, balance binary, nonce binary")
    leaves = table.select(F.col("state").alias("trie"), F.col("account").alias("path"), rlp.account_items(F.col("balance"), F.col("nonce"), F.lit(None).cast("binary"), F.lit(None).cast("binary")).alias("i")).select("trie", "path", rlp.list_of(F.col("i")).alias("value"))
    return tries.roots(leaves)[0].select(F.col("trie").alias("state"), F.hex("root").alias("root"))


@_query("SELECT 'C8F9C9C3A0E95E13D6F6B7E0DF65052A0CC484AB0DB3E57C287DF74F2714D5B3' AS root, 'C482200103' AS inlined, '56E81F171BCC55A6FF8345E692C0F86E5B48E01B996CADC001622FB5E363B421' AS empty, 'A624947D9693A5CBA0701897B3A48CB9954C2F4FD54DE36151800EB2C7F6BF50' AS later, true AS same_storage")
def golden_storage_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state with inlined storage nodes, a leaf that is its own reference, the empty state, and a root after a change of one part."""
    slot = "C" * 20 + "D" * 16 + "E" * 26
    accounts = lambda *rows: spark.createDataFrame([(k, b.to_bytes(32, "big"), n.to_bytes(32, "big")) for k, b, n in rows], "account string, balance binary, nonce binary")
    storage = spark.createDataFrame([(_K0, slot + "B1", bytes([1, 2, 3])), (_K0, slot + "B2", bytes([10, 20, 30]))], "account string, slot string, value binary")
    root = tries.state_root(accounts((_K0, 0, 1)), storage).select(F.hex("root").alias("root"))
    empty = tries.state_root(accounts((_K0, 0, 1)).limit(0)).select(F.hex("root").alias("empty"))
    first, both = (tries.account_leaves(accounts(*x)) for x in ([(_K0, 13, 23), (_K2, 1, 1)], [(_K0, 13, 23), (_K1, 17, 29)]))
    parts = tries.updated_parts(tries.reduced_parts(first), both, spark.createDataFrame([("", _K1), ("", _K2)], "trie string, path string"))
    later = tries.roots_of_parts(parts).select(F.hex("root").alias("later"))
    same = tries.storage_root(storage, _K0).select("root").join(tries.storage_subtrie_root(storage, _K0, "").select(F.col("root").alias("other"))).select((F.col("root") == F.col("other")).alias("same_storage"))
    leaf = spark.range(1).select(F.hex(rlp.leaf_node(F.lit("01"), rlp.byte_string(F.lit(b"\x03")))).alias("inlined"))
    return root.join(leaf).join(empty).join(later).join(same)


@_query(
    _LCP
    + """, f AS (SELECT trie, prefix, d FROM b UNION ALL SELECT trie, substr(prefix, 1, up + 1), up + 1 FROM u WHERE d > up + 1),
n AS (SELECT trie, substr(path, 1, d + 1) AS path, 'leaf' AS kind, 0 AS own FROM l UNION ALL SELECT trie, prefix, 'branch', 1 FROM b UNION ALL SELECT trie, substr(prefix, 1, up + 1), 'extension', 1 FROM u WHERE d > up + 1)
SELECT trie, kind, level, count(*) AS nodes FROM (SELECT n.trie, n.kind, n.path, CAST(count(f.prefix) - n.own AS INTEGER) AS level FROM n LEFT JOIN f ON f.trie = n.trie AND starts_with(n.path, f.prefix) GROUP BY n.trie, n.kind, n.path, n.own) GROUP BY ALL"""
)
def trie_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep the nodes of two tries lie, counted in nodes."""
    nodes = tries.structure(_two_tries(spark, sf_dir), levels=True)
    return nodes.groupBy("trie", "kind", "level").agg(F.count(F.lit(1)).alias("nodes"))


@_query("""WITH a AS (SELECT count(*) AS n FROM customer), s AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS tries FROM orders)
SELECT a.n AS accounts, s.n AS slots, s.tries AS storage_tries, true AS one_root, CAST(0 AS BIGINT) AS without_reference FROM a, s""")
def trie_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the state's trie and of every storage trie: a leaf for each account and slot, a top for each trie."""
    seen = tries.visit(adapters.accounts_of(_table(spark, sf_dir, "customer")), adapters.storage_of(_table(spark, sf_dir, "orders")))
    return seen.agg(
        F.count_if((F.col("kind") == "leaf") & ~F.col("is_storage")).alias("accounts"), F.count_if((F.col("kind") == "leaf") & F.col("is_storage")).alias("slots"), F.count_if((F.col("level") == 0) & F.col("is_storage")).alias("storage_tries"),
        (F.count_if((F.col("level") == 0) & ~F.col("is_storage")) == 1).alias("one_root"), F.count_if(F.col("hash").isNull() & F.col("encoded").isNull()).alias("without_reference"),
    )


@_query(f"""WITH h AS (SELECT DISTINCT substr(path, 1, 1) AS p FROM {_KEYED} UNION SELECT DISTINCT substr(path, 1, 2) FROM {_KEYED}), b AS (SELECT p AS path, CAST((SELECT sum(1 << (instr('0123456789ABCDEF', substr(c.p, length(c.p), 1)) - 1)) FROM h c WHERE length(c.p) = length(h.p) + 1 AND starts_with(c.p, h.p)) AS INTEGER) AS children FROM h WHERE length(p) = 1)
SELECT path, 'branch' AS kind, children, path < '8' AS persisted, path < '8' AS with_hash, false AS with_other, false AS at_key FROM b UNION ALL SELECT '', 'extension', 0, true, true, false, false""")
def synced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches and an extension known by their children's hashes, and whether they persist: proofs don't, and no node lies at a whole key."""
    digest = lambda p: F.unhex(F.sha2(F.concat(F.lit("h"), p), 256))
    twos = _customers(spark, sf_dir).select(F.substring("path", 1, 2).alias("p")).distinct()
    kids = F.collect_list(F.struct(F.substring("p", 2, 1).alias("nibble"), digest(F.col("p")).alias("hash")))
    branches = tries.synced_branches(twos.groupBy(F.substring("p", 1, 1).alias("path")).agg(kids.alias("children")).select(F.lit("").alias("account"), "path", "children", (F.col("path") < "8").alias("persist")))
    top = tries.synced_extensions(spark.createDataFrame([("", "", "0", b"\x01" * 32, True)], "account string, path string, node_path string, child binary, persist boolean"))
    nodes = stored(branches.unionByName(top), "synced")
    ask = lambda hash_, name: tries.persisted(nodes.select("account", "path", hash_.alias("hash")), nodes).select("path", F.col("persisted").alias(name))
    at_key = lambda: F.rpad(F.concat("path", F.lit("8")), 64, "0")
    key = nodes.withColumn("path", at_key())
    whole = tries.persisted(key.select("account", "path", F.lit(None).cast("binary").alias("hash")), key).select(F.col("path").alias("_key"), F.col("persisted").alias("at_key"))
    out = nodes.select("path", "kind", "children").join(ask(F.lit(None).cast("binary"), "persisted"), "path").join(ask(F.col("ref"), "with_hash"), "path").join(ask(F.lit(b"\x00" * 32), "with_other"), "path")
    return out.join(whole, at_key() == F.col("_key")).drop("_key")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
