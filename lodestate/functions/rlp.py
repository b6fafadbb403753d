"""RLP, hex-prefix and account encodings as Column expressions (in the JVM, within code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import let, minimal, padded32, uint_bytes
from .keccak import EMPTY_CODE, EMPTY_TREE


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def _with_header(payload: Column, short: int, long_: int) -> Column:
    """payload (a plain column or bound value) behind its header."""
    n = F.octet_length(payload)
    long_header = let(uint_bytes(n), lambda size: F.concat(_byte(F.octet_length(size) + long_), size))
    return F.concat(F.when(n < 56, _byte(n + short)).otherwise(long_header), payload)


def byte_string(value: Column) -> Column:
    """RLP of BINARY; a single byte below 0x80 stands for itself."""
    return let(value, lambda v: F.when((F.octet_length(v) == 1) & (v < F.lit(b"\x80")), v).otherwise(_with_header(v, 0x80, 0xB7)))


def integer(value: Column) -> Column:
    """RLP of a big-endian integer of any width; zero is 0x80."""
    return byte_string(minimal(value))


def list_of(payload: Column) -> Column:
    """RLP list whose encoded items are already put together."""
    return let(payload, lambda p: _with_header(p, 0xC0, 0xF7))


def sequence(*items: Column) -> Column:
    """RLP list of encoded items."""
    return list_of(F.concat(*items))


def length_of(value: Column) -> Column:
    return F.octet_length(byte_string(value))


def length_of_integer(value: Column) -> Column:
    """RLP length of a big-endian integer: 1 below 128."""
    return F.octet_length(integer(value))


def length_of_length(n: Column) -> Column:
    """Bytes that a length takes; 1 for zero."""
    return F.greatest(F.lit(1), F.octet_length(uint_bytes(n)))


def length_of_sequence(content_length: Column) -> Column:
    extra = F.when(content_length < 56, F.lit(0)).otherwise(F.octet_length(uint_bytes(content_length)))
    return content_length + 1 + extra


def decode_integer(data: Column) -> Column:
    """32-byte integer of a canonical RLP string; null for empty, over-long, badly sized or zero-led input."""

    def read(d: Column) -> Column:
        n = F.octet_length(d)
        first = F.conv(F.substr(F.hex(d), F.lit(1), F.lit(2)), 16, 10).cast("int")
        body = F.substr(d, F.lit(2))
        good = (first <= 0xA0) & (n == first - 0x80 + 1) & ((n == 1) | (F.hex(F.substr(body, F.lit(1), F.lit(1))) != "00")) & ~((n == 2) & (body < F.lit(b"\x80")))
        return F.when((n == 1) & (first < 0x80) & (first > 0), padded32(d)).when((first >= 0x80) & good, padded32(body))

    return let(data, read)


def hex_prefix(path: Column, leaf: bool) -> Column:
    """Compact encoding of a nibble path with its leaf and odd flags."""
    even, odd = ("20", "3") if leaf else ("00", "1")
    return F.unhex(let(path, lambda p: F.concat(F.when(F.length(p) % 2 == 1, F.lit(odd)).otherwise(F.lit(even)), p)))


def leaf_node(path: Column, value: Column) -> Column:
    """Leaf with an encoded value, which is a string inside the node."""
    return sequence(byte_string(hex_prefix(path, True)), byte_string(value))


def extension_node(path: Column, child: Column) -> Column:
    return sequence(byte_string(hex_prefix(path, False)), child)


def account_items(balance: Column, nonce: Column, storage_root: Column, code_hash: Column) -> Column:
    """The items of an account as it stands in its leaf: nonce, balance, storage root, code hash."""
    return F.concat(integer(nonce), integer(balance), byte_string(F.coalesce(storage_root, F.lit(EMPTY_TREE))), byte_string(F.coalesce(code_hash, F.lit(EMPTY_CODE))))


def account_bytes(balance: Column, nonce: Column, code_hash: Column, storage_root: Column) -> Column:
    """Compact account: one preamble byte when balance and nonce are small (and no hashes if both are the empty ones)."""

    def write(a: Column) -> Column:
        bl, nl = F.octet_length(a["b"]), F.octet_length(a["n"])
        plain = (a["code"] == F.lit(EMPTY_CODE)) & (a["root"] == F.lit(EMPTY_TREE))
        dense = (bl <= 15) & (nl <= 3)
        preamble = F.when(dense, _byte(F.lit(0x80) + F.when(plain, F.lit(0)).otherwise(F.lit(0x40)) + nl * 16 + bl)).otherwise(F.concat(_byte(bl), _byte(nl)))
        return F.concat(preamble, a["b"], a["n"], F.when(dense & plain, F.lit(b"")).otherwise(F.concat(a["code"], a["root"])))

    return let(F.struct(minimal(balance).alias("b"), minimal(nonce).alias("n"), F.coalesce(code_hash, F.lit(EMPTY_CODE)).alias("code"), F.coalesce(storage_root, F.lit(EMPTY_TREE)).alias("root")), write)


def account_with(data: Column, **fields: Column) -> Column:
    """An encoded account with some of its fields (balance, nonce, code_hash, storage_root) replaced."""
    return let(account_from_bytes(data), lambda a: account_bytes(*[fields.get(f, a[f]) for f in ("balance", "nonce", "code_hash", "storage_root")]))


def account_from_bytes(data: Column) -> Column:
    """Struct (balance, nonce, code_hash, storage_root) of ``account_bytes``; null data is the empty account."""

    def head(d: Column) -> Column:
        """Where things are: lengths, the first place, and whether the hashes are there."""
        first = F.coalesce(F.conv(F.substr(F.hex(d), F.lit(1), F.lit(2)), 16, 10).cast("int"), F.lit(0x80))
        second = F.conv(F.substr(F.hex(d), F.lit(3), F.lit(2)), 16, 10).cast("int")
        return let(first, lambda f: F.struct(
            d.alias("d"),
            F.when(f >= 0x80, f.bitwiseAND(15)).otherwise(f).alias("bl"),
            F.when(f >= 0x80, F.shiftright(f, 4).bitwiseAND(3)).otherwise(second).alias("nl"),
            F.when(f >= 0x80, F.lit(2)).otherwise(F.lit(3)).alias("at"),
            ((f < 0x80) | (f.bitwiseAND(0x40) != 0)).alias("hashed"),
        ))

    def read(h: Column) -> Column:
        piece = lambda start, length: F.coalesce(F.substr(h["d"], start, length), F.lit(b""))
        hashes = h["at"] + h["bl"] + h["nl"]
        return F.struct(
            padded32(piece(h["at"], h["bl"])).alias("balance"),
            padded32(piece(h["at"] + h["bl"], h["nl"])).alias("nonce"),
            F.when(h["hashed"], piece(hashes, F.lit(32))).otherwise(F.lit(EMPTY_CODE)).alias("code_hash"),
            F.when(h["hashed"], piece(hashes + 32, F.lit(32))).otherwise(F.lit(EMPTY_TREE)).alias("storage_root"),
        )

    return let(let(data, head), read)
