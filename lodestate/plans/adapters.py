"""State-store shapes from ordinary tables: op logs, blocks and keyed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ACCOUNT, STORAGE
from ..operators.overlay import DESTROY, SET


def hashed_key(value: Column) -> Column:
    """64-nibble path of any id."""
    return F.upper(F.sha2(value.cast("string"), 256))


def event_ops(events: DataFrame, destroy_type: str = "error") -> DataFrame:
    """An op log: one block for each day of events; a user is an account, an event type a slot, its value the slot's bytes.

    Events of destroy_type destroy their account. seq orders all ops.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    destroy = F.col("event_type") == destroy_type
    return events.select(
        day.alias("block_hash"),
        F.col("event_id").alias("seq"),
        F.when(destroy, F.lit(DESTROY)).otherwise(F.lit(SET)).cast("int").alias("op"),
        F.lit(STORAGE).alias("type"),
        hashed_key(F.col("user_id")).alias("account"),
        F.when(destroy, F.lit("")).otherwise(F.upper(F.hex(F.encode(F.col("event_type"), "UTF-8")))).alias("slot"),
        F.when(~destroy, F.encode(F.col("value").cast("decimal(18,2)").cast("string"), "UTF-8")).alias("value"),
        F.lit(0).alias("entry_type"),
        F.col("user_id"),
        F.col("event_type"),
    )


def day_blocks(events: DataFrame) -> DataFrame:
    """A chain of one block a day, each the child of the day before."""
    from pyspark.sql import Window

    days = events.select(F.date_format("ts", "yyyy-MM-dd").alias("state_hash")).distinct()
    along = Window.orderBy("state_hash")  # one row a day
    return days.select("state_hash", F.coalesce(F.lag("state_hash").over(along), F.lit("")).alias("parent_hash"), F.row_number().over(along).cast("long").alias("number"))


def keyed(df: DataFrame, key: str, *value: str) -> DataFrame:
    """(id, path, value): entries under the hash of a column; the other columns, joined, are the value's bytes."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in value]) if value else F.col(key).cast("string")
    return df.select(F.col(key).alias("id"), hashed_key(F.col(key)).alias("path"), F.encode(text, "UTF-8").alias("value"))


def accounts_of(customers: DataFrame) -> DataFrame:
    """Accounts of customers: the balance in cents (negatives count as zero), the nonce from the nation."""
    from ..functions.bits import uint_bytes

    cents = F.greatest(F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(0).cast("long"))
    return customers.select(hashed_key(F.col("c_custkey")).alias("account"), uint_bytes(cents).alias("balance"), uint_bytes(F.col("c_nationkey").cast("long")).alias("nonce"), F.lit(ACCOUNT).alias("type"))


def storage_of(orders: DataFrame) -> DataFrame:
    """Storage of customers: a slot for each order, holding its price in cents."""
    from ..functions.bits import uint_bytes

    return orders.select(hashed_key(F.col("o_custkey")).alias("account"), hashed_key(F.col("o_orderkey")).alias("slot"), uint_bytes(F.round(F.col("o_totalprice") * 100).cast("long")).alias("value"))
