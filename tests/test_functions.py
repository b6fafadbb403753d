from pyspark.sql import functions as F

from lodestate.functions import bits, paths, rlp
from lodestate.functions.keccak import EMPTY_CODE, EMPTY_TREE, keccak256_many


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keccak_known_digests_and_block_borders():
    assert keccak256_many([b"", b"\x80"]) == [EMPTY_CODE, EMPTY_TREE]
    many = [bytes([i % 251]) * i for i in range(300)]
    assert keccak256_many(many) == [keccak256_many([x])[0] for x in many]
    assert len(set(keccak256_many(many))) == 300


def test_inline_storage_leaf(spark):
    leaf = rlp.leaf_node(F.lit("01"), rlp.byte_string(F.lit(b"\x03")))
    assert one(spark, F.hex(leaf)) == "C482200103"


def test_rlp_strings_and_lists(spark):
    assert bytes(one(spark, rlp.byte_string(F.lit(b"dog")))) == b"\x83dog"
    assert bytes(one(spark, rlp.byte_string(F.lit(b"")))) == b"\x80"
    assert bytes(one(spark, rlp.byte_string(F.lit(b"a" * 56))))[:2] == b"\xb8\x38"
    assert bytes(one(spark, rlp.sequence(rlp.byte_string(F.lit(b"cat")), rlp.byte_string(F.lit(b"dog"))))) == b"\xc8\x83cat\x83dog"
    assert one(spark, rlp.decode_integer(F.lit(b"\x81\x05"))) is None
    assert one(spark, rlp.decode_integer(F.lit(b"\x82\x00\x05"))) is None
    assert one(spark, rlp.length_of_sequence(F.lit(60))) == 62


def test_account_codec_lengths(spark):
    none = F.lit(None).cast("binary")
    number = lambda n: F.lit(n.to_bytes(32, "big"))
    assert one(spark, F.octet_length(rlp.account_bytes(number(1), number(1), none, none))) == 3
    assert one(spark, F.octet_length(rlp.account_bytes(number(0), number(0), none, none))) == 1
    for balance, nonce in ((5, 2), (2**200, 7), (2**256 - 1, 2**256 - 1)):
        back = one(spark, rlp.account_from_bytes(rlp.account_bytes(number(balance), number(nonce), none, none)))
        assert (int.from_bytes(back.balance, "big"), int.from_bytes(back.nonce, "big"), bytes(back.code_hash)) == (balance, nonce, EMPTY_CODE)


def test_missing_account_is_the_empty_one(spark):
    back = one(spark, rlp.account_from_bytes(F.lit(None).cast("binary")))
    assert int.from_bytes(back.balance, "big") == 0 and bytes(back.storage_root) == EMPTY_TREE


def test_common_prefix(spark):
    cases = [("ABCD", "ABCE", 3), ("", "AB", 0), ("AB", "AB", 2), ("AB", "ABC", 2), ("1", "2", 0)]
    rows = spark.createDataFrame(cases, "a string, b string, want int").withColumn("got", paths.common_prefix(F.col("a"), F.col("b")))
    assert [r.got for r in rows.collect()] == [c[2] for c in cases]


def test_paths(spark):
    assert one(spark, paths.parse(F.lit("0xab1"))) == "AB1"
    assert one(spark, paths.parse(F.lit("xyz"))) is None
    assert one(spark, paths.from_key(F.lit(b"\x12\x34"), 1)) == "234"
    assert one(spark, paths.from_nibbles(F.array(F.lit(10), F.lit(3)))) == "A3"
    assert one(spark, paths.nibble_at(F.lit("1F"), 1)) == 15


def test_bit_sets(spark):
    mask = F.lit(0b1000_0000_0010_0100)
    assert [one(spark, f(mask)) for f in (bits.count, bits.smallest, bits.largest)] == [3, 2, 15]
    assert one(spark, bits.rank(mask, F.lit(5))) == 2
    assert one(spark, bits.smallest(F.lit(0))) is None
    assert one(spark, bits.smallest_missing(F.lit(0b111))) == 3
    assert bytes(one(spark, bits.without_leading_zeros(F.lit(b"\x00\x00")))) == b"\x00"
