"""Command line over a snapshot store: python -m lodestate stats|verify|storage PATH."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chain import View
from .functions.paths import ACCOUNT
from .operators import stats, tries
from .sources.snapshots import SnapshotStore


def node_sizes(state: DataFrame) -> DataFrame:
    """(scope, kind, depth, used) of all trie nodes of a state; a leaf's size is its entry's."""
    is_account = F.col("type") == ACCOUNT
    keys = state.where(F.octet_length("value") > 0).select(F.when(is_account, F.lit("")).otherwise(F.col("account")).alias("trie"), F.when(is_account, F.col("account")).otherwise(F.col("slot")).alias("path"), stats.entry_size("account").alias("size"))
    nodes = tries.structure(keys)
    leaves = nodes.where("kind = 'leaf'").select("trie", F.concat("path", "node_path").alias("path"), F.length("path").alias("depth")).join(keys, ["trie", "path"])
    scope = F.when(F.col("trie") == "", "State").otherwise("Storage").alias("scope")
    others = nodes.where("kind != 'leaf'").select(scope, "kind", F.length("path").alias("depth"), (F.length("node_path") + 2 * F.bit_count("children") + 1).cast("long").alias("used"))
    return leaves.select(scope, F.lit("leaf").alias("kind"), "depth", F.col("size").cast("long").alias("used")).unionByName(others)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestate", description=__doc__)
    parser.add_argument("command", choices=("stats", "verify", "storage"))
    parser.add_argument("path")
    parser.add_argument("--history", type=int, default=2)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestate").getOrCreate()
    store = SnapshotStore(spark, args.path, args.history)
    state = store.read_latest()
    if args.command == "stats":
        stats.by_depth(node_sizes(state), exact=False).orderBy("scope", "kind", "depth").show(200, False)
        stats.count_by_nibble(state, "account").orderBy("nibble").show()
    elif args.command == "storage":
        state.where(F.col("type") != ACCOUNT).groupBy("account").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.octet_length("value")).alias("bytes")).orderBy(F.desc("slots")).show(20, False)
    else:
        last = store.latest()
        root = View(state.select("account", "slot", "type", "value"), "").root()
        print(f"block {last.block_number if last else 0}: root {root}, recorded {last.state_hash if last else '-'}")
        return int(last is not None and root != last.state_hash)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
