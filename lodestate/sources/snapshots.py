"""Versioned snapshots: immutable Parquet tables of live keys with a manifest of retained versions.

A version is a folder of (account, slot, type, value), partitioned by the first nibbles of the account; its row in
the manifest is written last, so readers see whole versions only, and keep what they opened while writers go on. The
manifest is a table of small rows: one for each version, of which the newest ``history`` count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_STATE = "account string, slot string, type int, value binary, nib01 string"
_MANIFEST = "batch_id long, block_number long, state_hash string, path string"


class StateGone(KeyError):
    """The asked state isn't among the retained versions."""


class SnapshotStore:
    """A folder of snapshots. flush: False keeps a version out of the manifest until ``flush()``."""

    #: How far a commit goes: data and manifest; data alone, published by ``flush``; nothing written until ``flush``.
    DATA_AND_ROOT, DATA_ONLY, NO_WRITE = "data and root", "data only", "no write"

    def __init__(self, spark: SparkSession, path: str, history: int = 2, partition_nibbles: int = 1) -> None:
        if history < 2:
            raise ValueError("history must be at least 2")
        self.spark, self.path, self.history = spark, path.rstrip("/"), history
        self.partition_nibbles = partition_nibbles
        self._pending: list[Row] = []
        self._unwritten: dict[str, DataFrame] = {}

    # manifest ---------------------------------------------------------------------------------------------------

    def _rows(self) -> list[Row]:
        """Retained versions, newest first (at most ``history`` rows reach the driver)."""
        if not self._exists("manifest"):
            return []
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").dropDuplicates(["batch_id"]).orderBy(F.desc("batch_id")).limit(self.history).collect()

    def _at(self, path: str):
        """(file system, path) of a place in the store, or of a full path."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path if path.startswith(self.path) else f"{self.path}/{path}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._at(path)
        return fs.exists(hadoop)

    def _children(self, path: str) -> list[str]:
        fs, hadoop = self._at(path)
        return [str(x.getPath().toString()) for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """One writer at a time, on any driver: the lock is a file that only one can create."""
        fs, lock = self._at("_writer")
        try:
            fs.create(lock, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"another batch is being written (or a writer has died: then delete {self.path}/_writer)") from e
        try:
            yield
        finally:
            fs.delete(lock, False)

    def has_state(self, state_hash: str) -> bool:
        return any(r.state_hash == state_hash for r in self._rows())

    def latest(self) -> Row | None:
        return next(iter(self._rows()), None)

    # readers ----------------------------------------------------------------------------------------------------

    def _read(self, row: Row | None) -> DataFrame:
        if row is None:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(row.path)

    def read_latest(self) -> DataFrame:
        """The newest version; empty before the first commit."""
        return self._read(self.latest())

    def read(self, state_hash: str) -> DataFrame:
        """The version of a state hash."""
        for row in self._rows():
            if row.state_hash == state_hash:
                return self._read(row)
        raise StateGone(state_hash)

    def read_or_latest(self, state_hash: str) -> DataFrame:
        try:
            return self.read(state_hash)
        except StateGone:
            return self.read_latest()

    def head(self) -> Row | None:
        """What the next commit comes after: this store's last commit, published or not; else the newest version."""
        return self._pending[-1] if self._pending else self.latest()

    def read_head(self) -> DataFrame:
        """The state of ``head``: what a writer builds on. Readers that ask for the latest see published versions only."""
        row = self.head()
        if row is not None and row.path in self._unwritten:
            return self._keyed(self._unwritten[row.path])
        return self._read(row)

    def read_all(self) -> DataFrame:
        """All retained versions, with batch_id, block_number and state_hash."""
        parts = [self._read(r).withColumns({"batch_id": F.lit(r.batch_id).cast("long"), "block_number": F.lit(r.block_number).cast("long"), "state_hash": F.lit(r.state_hash)}) for r in self._rows()]
        return reduce(DataFrame.unionByName, parts) if parts else self._read(None).withColumns({"batch_id": F.lit(0).cast("long"), "block_number": F.lit(0).cast("long"), "state_hash": F.lit("")})

    # writer -----------------------------------------------------------------------------------------------------

    def commit(self, state: DataFrame, block_number: int, state_hash: str, flush: bool | str = True) -> Row:
        """Make state the next version. One writer at a time; readers of older versions aren't touched.

        flush: how far to go (DATA_AND_ROOT, DATA_ONLY or NO_WRITE; True and False stand for the first two).
        """
        level = {True: self.DATA_AND_ROOT, False: self.DATA_ONLY}.get(flush, flush)
        with self._writing():
            last = self.head()
            row = Row(batch_id=(last.batch_id if last else 0) + 1, block_number=block_number, state_hash=state_hash, path=f"{self.path}/versions/{uuid.uuid4().hex}")
            if level == self.NO_WRITE:
                self._unwritten[row.path] = state
            else:
                self._write(state, row.path)
            self._pending.append(row)
            if level == self.DATA_AND_ROOT:
                self._publish()
            return row

    def _keyed(self, state: DataFrame) -> DataFrame:
        return state.select("account", "slot", F.col("type").cast("int").alias("type"), "value", F.substring("account", 1, self.partition_nibbles).alias("nib01"))

    def _write(self, state: DataFrame, path: str) -> None:
        """Dealt by more nibbles than the folders have, of accounts and slots: neither a nibble nor an account is one task's work."""
        dealt = self._keyed(state).repartition(F.col("nib01"), F.substring("account", 1, 5), F.substring("slot", 1, 2))
        dealt.sortWithinPartitions("nib01", "account", "slot").write.partitionBy("nib01").parquet(path)

    def _publish(self) -> None:
        for row in self._pending:
            if (state := self._unwritten.pop(row.path, None)) is not None:
                self._write(state, row.path)
        self.spark.createDataFrame([tuple(r) for r in self._pending], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._pending = []

    def pending(self) -> list[str]:
        """State hashes that were committed but not published."""
        return [r.state_hash for r in self._pending]

    def flush(self) -> None:
        """Publish what was committed."""
        if self._pending:
            with self._writing():
                self._publish()

    def vacuum(self) -> int:
        """Delete the folders of versions beyond the history and of writers that died, and join the manifest's files; returns how many folders went."""
        with self._writing():
            rows = self._rows()
            kept = {r.path.rsplit("/", 1)[1] for r in [*rows, *self._pending]}
            gone = 0
            for path in self._children("versions"):
                if path.rsplit("/", 1)[1] not in kept:
                    fs, hadoop = self._at(f"versions/{path.rsplit('/', 1)[1]}")
                    gone += bool(fs.delete(hadoop, True))
            files = [x.rsplit("/", 1)[1] for x in self._children("manifest")]
            if sum(x.endswith(".parquet") for x in files) > 1:
                # the joined file is there before the others go; readers count a version once
                self.spark.createDataFrame([tuple(r) for r in rows], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
                for name in files:
                    if name.endswith(".parquet"):
                        fs, hadoop = self._at(f"manifest/{name}")
                        fs.delete(hadoop, False)
            return gone

    def parts(self) -> DataFrame:
        """(batch_id, block_number, file, nib01, entries, bytes): what each retained version's files hold."""
        each = self.read_all().select("batch_id", "block_number", F.input_file_name().alias("file"), "nib01", (F.length("account") / 2 + F.length("slot") / 2 + F.octet_length("value")).alias("size"))
        return each.groupBy("batch_id", "block_number", "file", "nib01").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").cast("long").alias("bytes"))
