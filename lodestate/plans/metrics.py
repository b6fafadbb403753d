"""Measurements beside the data: observed columns of batch jobs, and gauges, counters and histograms of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, **columns: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation whose ``get`` has the aggregates once an action on df has ended: no job of its own."""
    watch = Observation()
    return df.observe(watch, *[c.alias(name) for name, c in columns.items()]), watch


class StreamMetrics(StreamingQueryListener):
    """Samples of each micro-batch of the session's streams; ``table`` sums them up by name.

    The last value of a name is its gauge, the sum its counter, and quantiles stand for its histogram. Samples are
    numbers of micro-batches, a few for each; the newest ``kept`` of them stay.
    """

    def __init__(self, kept: int = 100_000) -> None:
        self.samples: list[tuple[int, str, float]] = []
        self.kept = kept

    def record(self, batch: int, name: str, value: float) -> None:
        self.samples.append((batch, name, float(value)))
        del self.samples[: -self.kept]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.record(p.batchId, "rows", p.numInputRows)
        for name, ms in (p.durationMs or {}).items():
            self.record(p.batchId, f"ms.{name}", ms)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, last, total, samples, p50, p99, highest)."""
        return summary(spark.createDataFrame(self.samples, "batch long, name string, value double"))


def summary(samples: DataFrame) -> DataFrame:
    """Gauge, counter and histogram figures of samples (batch, name, value)."""
    return samples.groupBy("name").agg(
        F.max_by("value", "batch").alias("last"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("samples"),
        F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.99)").alias("p99"), F.max("value").alias("highest"),
    )
