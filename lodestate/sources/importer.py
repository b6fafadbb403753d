"""Import of another node's trie leaves: (path, value) rows become accounts (64 nibbles) or storage (128 nibbles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import let, padded32
from ..functions.paths import ACCOUNT, PATH_LENGTH, STORAGE
from ..functions.rlp import account_bytes


def _first(data: Column) -> Column:
    return F.conv(F.substr(F.hex(data), F.lit(1), F.lit(2)), 16, 10).cast("int")


def _item(data: Column) -> Column:
    """Struct (item, rest) of a short string at the front of encoded items."""
    return let(
        F.struct(data.alias("d"), _first(data).alias("f")),
        lambda x: F.when(x["f"] < 0x80, F.struct(F.substr(x["d"], F.lit(1), F.lit(1)).alias("item"), F.substr(x["d"], F.lit(2)).alias("rest"))).otherwise(
            F.struct(F.substr(x["d"], F.lit(2), x["f"] - 0x80).alias("item"), F.substr(x["d"], x["f"] - 0x80 + 2).alias("rest"))
        ),
    )


def _account(value: Column) -> Column:
    """Struct (nonce, balance, storage_root, code_hash) of an account leaf's value: a list of four strings."""
    items = let(F.struct(value.alias("v"), _first(value).alias("f")), lambda x: F.when(x["f"] < 0xF8, F.substr(x["v"], F.lit(2))).otherwise(F.substr(x["v"], x["f"] - 0xF7 + 2)))
    one = let(items, lambda v: let(_item(v), lambda n: F.struct(n["item"].alias("nonce"), _item(n["rest"]).alias("b"))))
    return let(one, lambda x: F.struct(x["nonce"].alias("nonce"), x["b"]["item"].alias("balance"), F.substr(x["b"]["rest"], F.lit(2), F.lit(32)).alias("storage_root"), F.substr(x["b"]["rest"], F.lit(35), F.lit(32)).alias("code_hash")))


def import_leaves(leaves: DataFrame) -> DataFrame:
    """State rows (account, slot, type, value) of leaves (path, value), values encoded as the state keeps them."""
    is_account = F.length("path") == PATH_LENGTH
    accounts = leaves.where(is_account).select(F.upper("path").alias("account"), _account(F.col("value")).alias("a"))
    storage = leaves.where(F.length("path") == 2 * PATH_LENGTH)
    return accounts.select("account", F.lit("").alias("slot"), F.lit(ACCOUNT).alias("type"), account_bytes(padded32(F.col("a.balance")), padded32(F.col("a.nonce")), F.col("a.code_hash"), F.col("a.storage_root")).alias("value")).unionByName(
        storage.select(F.upper(F.substring("path", 1, 64)).alias("account"), F.upper(F.substring("path", 65, 64)).alias("slot"), F.lit(STORAGE).alias("type"), _item(F.col("value"))["item"].alias("value"))
    )
