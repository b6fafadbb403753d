"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_THREAD = threading.local()


def written() -> list[str]:
    """Paths of the tables that ``stored`` has written in this thread."""
    if not hasattr(_THREAD, "paths"):
        _THREAD.paths = []
    return _THREAD.paths


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, local runs get a folder of their own and clusters an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/lodestate"
    return base.rstrip("/")


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df written to the shared folder and read back: later steps start from files, and lost executors cost no more than their task.

    What made df is garbage then. release: collect it now, so that Spark's cleaner removes its shuffle files at once and
    not when memory happens to run low on the driver; twice, as events of the job that has just ended hold it for a moment.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written().append(path)
    schema = df.schema
    if release:
        del df
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
