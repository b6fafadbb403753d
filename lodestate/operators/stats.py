"""Structural statistics over keyed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import part_of, selected

#: Bytes that an entry takes beside its key and value.
OVERHEAD = 4


def count_by_nibble(entries: DataFrame, path: str = "path") -> DataFrame:
    return entries.groupBy(F.substring(path, 1, 1).alias("nibble")).agg(F.count(F.lit(1)).alias("entries"))


def entry_size(path: str = "path", value: str = "value", overhead: int = OVERHEAD) -> Column:
    return F.ceil(F.length(path) / 2) + F.octet_length(value) + overhead


def size_by(entries: DataFrame, bucket: Column, path: str = "path", value: str = "value") -> DataFrame:
    """Bytes of the entries in each bucket of a bucket expression; empty values don't count."""
    return entries.where(F.octet_length(value) > 0).groupBy(bucket.alias("bucket")).agg(F.sum(entry_size(path, value)).cast("long").alias("bytes"))


def buckets(entries: DataFrame, nibbles: int, path: str = "path", value: str = "value") -> DataFrame:
    """(prefix, entries, bytes) of every bucket of 0 to so many leading nibbles. The deepest are counted; the others are sums of these."""
    deepest = entries.groupBy(F.substring(path, 1, nibbles).alias("p")).agg(F.count(F.lit(1)).alias("entries"), F.sum(entry_size(path, value)).cast("long").alias("bytes"))
    above = deepest.select(F.explode(F.sequence(F.lit(0), F.lit(nibbles))).alias("n"), "p", "entries", "bytes")
    return above.groupBy(F.substr(F.col("p"), F.lit(1), F.col("n")).alias("prefix")).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def utilisation(entries: DataFrame, capacity: int) -> DataFrame:
    return entries.agg((F.sum(entry_size()) / F.lit(capacity)).alias("used"))


def used_histogram(parts: DataFrame, capacity: int, kind: str = "data", step: int = 10) -> DataFrame:
    """(kind, depth, percent, parts): how many parts of a kind are used by percent up to percent + step; full ones count as below 100.

    parts: (kind, depth, used: bytes).
    """
    percent = F.least(F.floor(F.col("used") * 100 / capacity), F.lit(99))
    return parts.where(F.col("kind") == kind).groupBy("kind", "depth", (F.floor(percent / step) * step).cast("long").alias("percent")).agg(F.count(F.lit(1)).alias("parts"))


def has_any(entries: DataFrame, selector: str, path: str = "path", value: str = "value") -> DataFrame:
    """One row (found): whether any live key's first nibble is in the selector's range."""
    live = entries.where(F.octet_length(value) > 0)
    return live.agg(F.coalesce(F.bool_or(selected(F.col(path), selector)), F.lit(False)).alias("found"))


def partitioned(entries: DataFrame, parts: int, path: str = "path", value: str = "value", selector: str = "all", tombstones: bool = False) -> DataFrame:
    """entries with ``part``, dealt by it; of those in the selector's range, and without empty values unless tombstones are kept."""
    own = entries.where(selected(F.col(path), selector)).withColumn("part", part_of(F.col(path), parts))
    return (own if tombstones else own.where(F.octet_length(value) > 0)).repartition("part")


def by_depth(nodes: DataFrame, exact: bool = True) -> DataFrame:
    """Counts and median of ``used`` per scope, kind and depth, with subtotals. exact=False uses the approximate median."""
    median = F.expr("percentile(used, 0.5)") if exact else F.percentile_approx("used", 0.5)
    return nodes.rollup("scope", "kind", "depth").agg(F.count(F.lit(1)).alias("nodes"), median.alias("p50"))


def consecutive(values: DataFrame, column: str, longest: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Runs of consecutive integers as (first, length), cut at longest. by: columns that a run stays within.

    Without by, the rows are dealt into ranges of 2**20 values first, so that no task sorts them all; runs that touch
    a border are joined in a second, small step.
    """
    width = 1 << 20
    distinct = values.select(*(by or []), F.col(column).cast("long").alias("v")).distinct()
    local = Window.partitionBy(*(by or []), F.shiftright("v", 20)).orderBy("v")
    runs = distinct.withColumn("g", F.col("v") - F.row_number().over(local)).groupBy(*(by or []), F.shiftright("v", 20).alias("part"), "g").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    # only runs that touch a border can go on beyond it; for wide gaps that is at most two a range
    at_border = (F.pmod(F.col("first"), F.lit(width)) == 0) | (F.pmod(F.col("last") + 1, F.lit(width)) == 0)
    whole = Window.partitionBy(*(by or [])).orderBy("first") if by else Window.orderBy("first")
    inner = runs.where(~at_border).select(*(by or []), "first", "last")
    border = runs.where(at_border)
    joined = border.withColumn("new", (F.col("first") != F.coalesce(F.lag("last").over(whole), F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("new").over(whole)).groupBy(*(by or []), "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    joined = joined.select(*(by or []), "first", "last").unionByName(inner)
    if longest is None:
        return joined.select(*(by or []), "first", (F.col("last") - F.col("first") + 1).alias("length"))
    pieces = joined.select(*(by or []), "last", F.explode(F.sequence("first", "last", F.lit(longest).cast("long"))).alias("first"))
    return pieces.select(*(by or []), "first", F.least(F.col("last") - F.col("first") + 1, F.lit(longest)).cast("long").alias("length"))


def highest_not_above(members: DataFrame, queries: DataFrame, member: str, query: str) -> DataFrame:
    """For each query value the largest member that isn't above it (null if none): one ordered pass over the distinct values of both.

    A range has at most 2**20 distinct values, so no task's memory grows with how often they are repeated.
    """
    both = members.select(F.col(member).cast("long").alias("v"), F.lit(True).alias("is_member"), F.lit(0).alias("asked")).unionByName(queries.select(F.col(query).cast("long").alias("v"), F.lit(False).alias("is_member"), F.lit(1).alias("asked")))
    values = both.groupBy("v").agg(F.max("is_member").alias("is_member"), F.sum("asked").alias("asked")).withColumn("part", F.shiftright("v", 20))
    near = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("m", F.max(F.when(F.col("is_member"), F.col("v"))).over(near))
    # ranges are carried over within ranges of ranges, and these among themselves: however far values lie apart, no task has all
    near = Window.partitionBy("far").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    below = values.groupBy("part").agg(F.max(F.when(F.col("is_member"), F.col("v"))).alias("top")).withColumn("far", F.shiftright("part", 20))
    fars = below.groupBy("far").agg(F.max("top").alias("top")).withColumn("from_far", F.max("top").over(all_before)).select("far", "from_far")
    carried = below.withColumn("own", F.max("top").over(near)).join(fars, "far").select("part", F.coalesce("own", "from_far").alias("before"))
    each = found.where("asked > 0").join(carried, "part", "left").select("v", F.when(F.col("v").isNotNull(), F.coalesce("m", "before")).alias("m"), "asked")
    # a value that was asked for several times has as many rows; in two steps, so that none holds a long list of them
    some = each.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked"), F.lit(1000).cast("long"))))
    return some.select(F.col("v").alias(query), F.col("m").alias(member), F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 999, F.col("asked")))).alias("_n")).drop("_n")


def first_gap(members: DataFrame, member: str) -> DataFrame:
    """The smallest non-negative integer that isn't a member."""
    runs = consecutive(members.where(F.col(member) >= 0).select(F.col(member).alias("v")), "v")
    return runs.agg(F.coalesce(F.max(F.when(F.col("first") == 0, F.col("length"))), F.lit(0)).alias("gap"))


def unreached(allocated: DataFrame, *reached: DataFrame, on: str = "address") -> DataFrame:
    """Integrity check: allocated rows that none of the others reaches. Empty when all is well."""
    for other in reached:
        allocated = allocated.join(other.select(on), on, "left_anti")
    return allocated
