"""Finalization as a stream: micro-batches of an op log are folded into snapshots, exactly once each."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import overlay
from ..operators.overlay import DESTROY, KEY, PERSISTENT, SET
from ..sources.snapshots import SnapshotStore

_CARRIED = "number long, seq long, op int, type int, account string, slot string, value binary, entry_type int"


def settled(ops: DataFrame) -> DataFrame:
    """What ops that are still to come can depend on: each key's last persistent set, each account's last destroy, each prefix's last delete."""
    ops = ops.where((F.col("op") != SET) | (F.col("entry_type") == PERSISTENT))
    slot = F.when(F.col("op") == DESTROY, F.lit("")).otherwise(F.col("slot"))
    type_ = F.when(F.col("op") == DESTROY, F.lit(0)).otherwise(F.col("type"))
    last = ops.groupBy("op", "account", type_.alias("type"), slot.alias("slot")).agg(F.max(F.struct("number", "seq", "value", "entry_type")).alias("l"))
    return last.select("l.number", "l.seq", "op", "type", "account", "slot", "l.value", "l.entry_type")


def live(ops: DataFrame) -> DataFrame:
    """The snapshot of settled ops, in whatever order they came."""
    return overlay.fold(ops.limit(0).select(*KEY, "value"), ops)


def fold_stream(ops: DataFrame, store: SnapshotStore, checkpoint: str, *, trigger: dict | None = None, number: str = "number") -> StreamingQuery:
    """Start folding a stream of ops (with a block ``number`` that never falls along the chain) into the store.

    Each micro-batch becomes one version, named by the highest block so far, the stream and the micro-batch; one that runs
    again after a failure finds its name and changes nothing. A block's ops may come in several micro-batches and blocks
    in any order: number and seq order the ops, and what late ones can depend on is carried along beside the version.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, last = store.spark, store.head()
        done = re.fullmatch(rf"block--?\d+-stream-{stream}-batch-(\d+)", last.state_hash) if last else None
        if done and int(done[1]) >= batch_id:
            return
        fresh = batch.select(*[F.col(number if c == "number" else c).cast(t).alias(c) for c, t in (x.split() for x in _CARRIED.split(", "))])
        top = fresh.agg(F.max("number")).first()[0]
        if top is None:
            return
        carried = f"{store.path}/carried"
        if last and "-stream-" in last.state_hash:
            known = spark.read.schema(_CARRIED).parquet(f"{carried}/{last.state_hash}")
        else:  # a version of another writer lies below all ops
            low = F.lit(-(1 << 62))
            known = store.read_head().select(low.alias("number"), low.alias("seq"), F.lit(SET).alias("op"), "type", "account", "slot", "value", F.lit(PERSISTENT).alias("entry_type"))
        top = max(top, last.block_number) if last else top
        name = f"block-{top}-stream-{stream}-batch-{batch_id}"
        settled(known.unionByName(fresh)).write.mode("overwrite").parquet(f"{carried}/{name}")
        store.commit(live(spark.read.schema(_CARRIED).parquet(f"{carried}/{name}")), top, name)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{carried}/{last.state_hash}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_values(ops: DataFrame, delay: str = "1 hour", *, time: str = "ts") -> DataFrame:
    """A stream of (account, slot, window, value): the last value of each slot in hourly windows, with late data up to delay."""
    return ops.withWatermark(time, delay).groupBy("account", "slot", F.window(time, "1 hour").alias("window")).agg(F.max_by("value", "seq").alias("value"))
