import uuid

import pytest
from pyspark.sql import functions as F

from lodestate.chain import EMPTY, Chain
from lodestate.functions import paths
from lodestate.operators import filters, overlay, stats, tries
from lodestate.sources.snapshots import SnapshotStore, StateGone

K0 = "0001020304050607" * 4
K1 = "0101020304050607" + "0001020304050607" * 3
K2 = "06" * 32


def accounts(spark, *rows):
    return spark.createDataFrame([(k, b.to_bytes(32, "big"), n.to_bytes(32, "big")) for k, b, n in rows], "account string, balance binary, nonce binary")


# State roots that any implementation of the same trie must give.
ROOTS = [
    ([(K0, 13, 23)], "E2533A0A0C4F1DDB72FEB7BFAAD12A83853447DEAAB6F28FA5C443DD2D37C3FB"),
    ([(K2, 19, 31)], "A654F039A5F9E9F30C89F21555C92F1CB1E739AF11A9E9B12693DEDC6E76F628"),
    ([(K0, 2**256 - 1, 23)], "FC790A3674B6847C609BB91B7014D67B2E70FF0E60F53AC49A8A45F1FECF35A6"),
    ([("10" + "00" * 31, 13, 23), ("20" + "00" * 31, 17, 29)], "73130DAA1AE507554A72811C06E28D4FEE671BFE2E1D0CEF828A7FADE54384F9"),
    ([(K0, 13, 23), (K1, 17, 29)], "A624947D9693A5CBA0701897B3A48CB9954C2F4FD54DE36151800EB2C7F6BF50"),
]


@pytest.mark.parametrize("rows,root", ROOTS)
def test_state_roots(spark, rows, root):
    assert bytes(tries.state_root(accounts(spark, *rows)).first().root).hex().upper() == root


def test_empty_state_root(spark):
    assert bytes(tries.state_root(accounts(spark, (K0, 1, 1)).limit(0)).first().root).hex().upper() == EMPTY


def test_inlined_storage_nodes(spark):
    slot = "C" * 20 + "D" * 16 + "E" * 26
    storage = spark.createDataFrame([(K0, slot + "B1", bytes([1, 2, 3])), (K0, slot + "B2", bytes([10, 20, 30]))], "account string, slot string, value binary")
    root = tries.state_root(accounts(spark, (K0, 0, 1)), storage).first().root
    assert bytes(root).hex() == "c8f9c9c3a0e95e13d6f6b7e0df65052a0cc484ab0db3e57c287df74f2714d5b3"


def test_structure_of_three_keys(spark):
    keys = spark.createDataFrame([("t", k) for k in ("A0000001", "B0000002", "C0000003")], "trie string, path string")
    nodes = sorted((r.kind, r.path, r.children) for r in tries.structure(keys).collect())
    assert nodes == [("branch", "", 1 << 10 | 1 << 11 | 1 << 12), *(("leaf", p, 0) for p in "ABC")]


def test_neighbours_over_bucket_borders(spark):
    keys = spark.createDataFrame([("t", f"{i:04X}") for i in range(0, 4096, 7)], "trie string, path string")
    whole = {r.path: (r.left, r.right) for r in tries.neighbours(keys, bucket_nibbles=0).collect()}
    assert whole == {r.path: (r.left, r.right) for r in tries.neighbours(keys, bucket_nibbles=2).collect()}


def test_chain_forks_destroy_and_history(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store", history=4)
    chain = Chain(store)
    for name, value in (("a", 1), ("b", 2)):
        block = chain.start()
        block.set_account(K0, value, value)
        block.set_storage(K0, K1, bytes([value]))
        assert block.commit(1, name) == name
    assert [chain.view(h).get_account(K0) for h in "ab"] == [(1, 1), (2, 2)]
    child = chain.start("a")
    child.destroy_account(K0)
    child.set_storage(K0, K2, b"\x09")
    child.commit(2, "c")
    state = {(r.type, r.slot): bytes(r.value) for r in chain.view("c").state.collect()}
    assert state == {(1, K2): b"\x09"}
    assert chain.view("c").get_account(K0) == (0, 0)
    assert chain.ancestors("c") == [("c", 2), ("a", 1)]
    with pytest.raises(StateGone):
        chain.start("00" * 32)
    assert chain.finalize("a") and chain.finalize("a")
    assert not chain.has_state("b")  # the fork of the same height
    assert chain.view("a").get_account(K0) == (1, 1) and chain.view("c").get_account(K0) == (0, 0)


def test_destroy_in_the_same_block_restores_the_hash(spark, tmp_path):
    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/s"))
    block = chain.start()
    block.set_account(K0, 1, 1)
    block.set_storage(K0, K1, b"\x01")
    block.destroy_account(K0)
    assert block.commit(1) == EMPTY and not chain.blocks


def test_retention_and_isolation(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/r", history=3)
    state = spark.createDataFrame([(K0, "", 0, b"\x01")], "account string, slot string, type int, value binary")
    store.commit(state, 1, "h1")
    reader = store.read("h1")
    for n in range(2, 6):
        store.commit(state.withColumn("value", F.lit(bytes([n]))), n, f"h{n}")
    assert bytes(reader.first().value) == b"\x01"
    assert [store.has_state(f"h{n}") for n in range(1, 6)] == [False, False, True, True, True]
    assert sorted(r.block_number for r in store.read_all().collect()) == [3, 4, 5]
    with pytest.raises(StateGone):
        store.read("h1")
    assert store.vacuum() == 2


@pytest.mark.parametrize("flush", [SnapshotStore.DATA_ONLY, SnapshotStore.NO_WRITE])
def test_commits_build_on_unpublished_ones(spark, tmp_path, flush):
    store = SnapshotStore(spark, f"file://{tmp_path}/u")
    assert store.head() is None and store.read_head().count() == 0
    for n in (1, 2, 3):
        own = spark.createDataFrame([(K0, f"{n:02X}", 1, bytes([n]))], "account string, slot string, type int, value binary")
        store.commit(store.read_head().select(*overlay.KEY, "value").unionByName(own.select(*overlay.KEY, "value")), n, f"h{n}", flush=flush if n == 2 else True)
        assert store.latest().state_hash == ("h1" if n == 2 else f"h{n}") and store.head().state_hash == f"h{n}"
        assert sorted(r.slot for r in store.read_head().collect()) == [f"{i:02X}" for i in range(1, n + 1)]
    assert sorted(r.slot for r in store.read("h2").collect()) == ["01", "02"]


def test_prefix_deletes(spark):
    state = spark.createDataFrame([("A" * 63 + c, "", 0, b"\x01") for c in "0123"] + [("B" * 64, "", 0, b"\x01"), ("B" * 64, "A" * 64, 1, b"\x02")], "account string, slot string, type int, value binary")
    delete = lambda *rows: overlay.remove_prefixes(state, spark.createDataFrame(rows, "account string, prefix string, type int")).count()
    assert delete(("", "A" * 63, 0)) == 2
    assert delete(("", "A", 0)) == 2
    assert delete(("", "", 0)) == 1
    assert delete(("B" * 64, "A", 1)) == 5


def test_prefix_read_prunes_partitions(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/p")
    store.commit(spark.createDataFrame([(f"{i:064X}"[::-1], "", 0, b"\x01") for i in range(64)], "account string, slot string, type int, value binary"), 1, "h")
    found = paths.under(store.read_latest(), "A", "account")
    assert found.count() == 4
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString() and "nib01" in found._jdf.queryExecution().toString()


def test_runs_and_gaps(spark):
    values = spark.createDataFrame([(v,) for v in (0, 1, 2, 5, 6, 1048575, 1048576, 9)], "v long")
    assert sorted(tuple(r) for r in stats.consecutive(values, "v").collect()) == [(0, 3), (5, 2), (9, 1), (1048575, 2)]
    assert stats.first_gap(values, "v").first().gap == 3
    queries = spark.createDataFrame([(4,), (8,), (2_000_000,), (-1,)], "q long")
    assert {r.q: r.v for r in stats.highest_not_above(values, queries, "v", "q").collect()} == {4: 2, 8: 6, 2_000_000: 1048576, -1: None}


def test_ancestors_by_query_equal_the_walk(spark):
    blocks = spark.createDataFrame([(f"h{i}", f"h{i - 1}", i) for i in range(1, 8)], "state_hash string, parent_hash string, number long")
    assert sorted(overlay.ancestors(blocks, "h7").collect()) == sorted(overlay.ancestors(blocks, "h7", walked=0).collect())
    with pytest.raises(KeyError):
        overlay.ancestors(blocks, str(uuid.uuid4()))


def test_stream_of_several_batches(spark, tmp_path):
    """Parts of a block, older blocks and ops before a destroy come late; the last batch runs again."""
    from lodestate.streaming.folding import fold_stream

    schema = "number long, block_hash string, seq long, op int, type int, account string, slot string, value binary, entry_type int"
    op = lambda n, seq, kind, account, slot, value=None: (n, f"b{n}", seq, kind, 1, account, slot, value, 0)
    batches = [
        [op(5, 50, 0, K0, "AA", b"\x50"), op(5, 52, 0, K1, "AA", b"\x52")],
        [op(5, 51, 0, K0, "BB", b"\x51"), op(5, 53, 0, K1, "CC", b"\x53")],
        [op(3, 30, 0, K0, "AA", b"\x30"), op(3, 31, 0, K0, "CC", b"\x31"), op(4, 40, 0, K1, "CD", b"\x40")],
        [op(5, 54, 1, K1, ""), op(4, 41, 2, K0, "C")],
        [op(6, 60, 0, K1, "DD", b"\x60"), op(6, 61, 0, K0, "BB", b"")],
    ]
    store = SnapshotStore(spark, f"file://{tmp_path}/store", history=9)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/ops")
        fold_stream(source, store, f"{tmp_path}/checkpoint").awaitTermination()
    state = {(r.account, r.slot): bytes(r.value) for r in store.read_latest().collect()}
    assert state == {(K0, "AA"): b"\x50", (K1, "DD"): b"\x60"}
    assert len(store._rows()) == len(batches)
    (tmp_path / "checkpoint" / "commits" / "4").unlink()
    (tmp_path / "checkpoint" / "commits" / ".4.crc").unlink(missing_ok=True)
    fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/ops"), store, f"{tmp_path}/checkpoint").awaitTermination()
    assert len(store._rows()) == len(batches)


OPS = "number long, block_hash string, seq long, op int, type int, account string, slot string, value binary, entry_type int"


def op(n, seq, kind, account, slot="", value=None, entry=0, type_=1):
    return n, f"b{n}", seq, kind, type_, account, slot, value, entry


def test_folding_blocks_at_once_equals_block_by_block(spark):
    import random

    r = random.Random(4)
    rows = []
    for n in range(1, 9):
        for seq in range(12):
            kind = r.choice([0, 0, 0, 0, 1, 2])
            account, slot = r.choice([K0, K1, K2]), r.choice(["AA", "AB", "B0", "BB"])
            if kind == 0:
                rows.append(op(n, n * 100 + seq, 0, account, slot, bytes([n, seq]) if r.random() < 0.8 else b"", r.choice([0, 0, 0, 1])))
            elif kind == 1:
                rows.append(op(n, n * 100 + seq, 1, account))
            else:
                rows.append(op(n, n * 100 + seq, 2, account, r.choice(["A", "B", "AA", ""])))
    ops = spark.createDataFrame(rows, OPS)
    state = ops.limit(0).select(*overlay.KEY, "value")
    for n in range(1, 9):
        state = spark.createDataFrame(overlay.fold(state, ops.where(F.col("number") == n).drop("number")).collect(), state.schema)
    once = overlay.fold(ops.limit(0).select(*overlay.KEY, "value"), ops)
    found = lambda df: sorted((x.account, x.slot, bytes(x.value)) for x in df.collect())
    assert found(state) == found(once) and found(once)
    chain = spark.createDataFrame([(f"b{n}", 8 - n) for n in range(1, 9)], "state_hash string, depth int")
    assert found(overlay.overlay(ops.where("entry_type = 0"), chain)) == found(once)


def test_overlay_honours_prefix_deletes(spark):
    ops = spark.createDataFrame([op(1, 1, 0, K0, "AA", b"\x01"), op(1, 2, 0, K0, "BA", b"\x02"), op(2, 3, 2, K0, "A"), op(2, 4, 0, K0, "AB", b"\x03")], OPS)
    base = spark.createDataFrame([(K0, 1, "AC", b"\x09"), (K1, 1, "AC", b"\x08")], "account string, type int, slot string, value binary")
    chain = spark.createDataFrame([("b2", 0), ("b1", 1)], "state_hash string, depth int")
    assert sorted((r.account, r.slot) for r in overlay.overlay(ops, chain, base).collect()) == [(K0, "AB"), (K0, "BA"), (K1, "AC")]


def test_reads_that_reach_the_snapshot(spark):
    ops = spark.createDataFrame([op(1, 1, 0, K0, "AA", b"\x01"), op(1, 2, 1, K1)], OPS)
    keys = spark.createDataFrame([(K0, "AA"), (K0, "AB"), (K1, "AA"), (K2, "AA")], "account string, slot string")
    assert tuple(overlay.fell_through(keys, ops).first()) == (4, 2)
    assert {(r.account, r.slot) for r in overlay.may_lie_in(keys, ops).where("may_contain").collect()} >= {(K0, "AA"), (K1, "AA")}


def test_merge_by_entry_type_and_hard_removal(spark):
    entry = "account string, type int, slot string, value binary, entry_type int"
    target = spark.createDataFrame([(K0, 1, "AA", b"\x01", 0), (K0, 1, "AB", b"\x02", 0)], entry)
    new = spark.createDataFrame([(K0, 1, "AA", b"\x03", 2), (K0, 1, "AC", b"\x04", 1), (K0, 1, "AB", b"", 0)], entry)
    state = {r.slot: bytes(r.value) for r in overlay.merged(target, new, (overlay.PERSISTENT, overlay.CACHED)).collect()}
    assert state == {"AA": b"\x01", "AB": b"", "AC": b"\x04"}
    assert [r.slot for r in overlay.discard(target, new.where("slot = 'AB'")).collect()] == ["AA"]


def plain_root(leaves):
    """Root of (path, encoded value) rows by the recursive definition, with nothing of the library's trie code."""
    from lodestate.functions.keccak import keccak256_many

    keccak = lambda x: keccak256_many([x])[0]

    def head(n, short):
        if n < 56:
            return bytes([short + n])
        size = n.to_bytes((n.bit_length() + 7) // 8, "big")
        return bytes([short + 55 + len(size)]) + size

    text = lambda x: x if len(x) == 1 and x[0] < 128 else head(len(x), 0x80) + x
    pack = lambda x: head(len(x), 0xC0) + x
    ref = lambda x: x if len(x) < 32 else text(keccak(x))
    compact = lambda p, leaf: bytes.fromhex((("3" if leaf else "1") + p) if len(p) % 2 else (("20" if leaf else "00") + p))

    def node(rows, depth):
        if len(rows) == 1:
            return pack(text(compact(rows[0][0][depth:], True)) + text(rows[0][1]))
        n = depth
        while len({p[n] for p, _ in rows}) == 1:
            n += 1
        kids = [[r for r in rows if r[0][n] == c] for c in "0123456789ABCDEF"]
        branch = pack(b"".join(ref(node(k, n + 1)) if k else b"\x80" for k in kids) + b"\x80")
        return branch if n == depth else pack(text(compact(rows[0][0][depth:n], False)) + ref(branch))

    return keccak(node(sorted(leaves), 0))


@pytest.fixture(scope="module")
def leaves():
    import random

    r = random.Random(12)
    key = lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(64))
    rows = [("a", key(), bytes([r.randrange(1, 256)] * r.randrange(1, 40))) for _ in range(400)]
    rows += [("b", "AB" * 10 + key()[:44], bytes([i + 1])) for i in range(40)] + [("c", key(), b"\x07")] + [("d", "0" * 63 + c, b"\x09") for c in "12F"]
    return rows


def test_roots_by_parts_equal_the_definition(spark, leaves):
    table = spark.createDataFrame(leaves, "trie string, path string, value binary").repartition(3)
    want = {t: plain_root([(p, v) for u, p, v in leaves if u == t]) for t in "abcd"}
    for subtrie in (1 << 15, 30, 3):
        assert {r.trie: bytes(r.root) for r in tries.reduced(table, subtrie=subtrie)[0].collect()} == want
    nodes = [sorted(tuple(r) for r in tries.reduced(table, keep=True, subtrie=n)[1].collect()) for n in (1 << 15, 5)]
    assert nodes[0] == nodes[1]
    plain = sorted(tuple(r) for r in tries.structure(table).collect())
    assert plain == [x[:5] for x in nodes[0]]


def test_roots_after_changes(spark, leaves):
    schema = "trie string, path string, value binary"
    parts = tries.reduced_parts(spark.createDataFrame(leaves, schema))
    later = [(t, p, b"\x55" if i % 50 == 0 else v) for i, (t, p, v) in enumerate(leaves) if i % 71] + [("e", "1" * 64, b"\x01")]
    changed = {(t, p) for t, p, _ in set(leaves) ^ set(later)}
    parts = tries.updated_parts(parts, spark.createDataFrame(later, schema), spark.createDataFrame(sorted(changed), "trie string, path string"))
    assert {r.trie: bytes(r.root) for r in tries.roots_of_parts(parts).collect()} == {t: plain_root([(p, v) for u, p, v in later if u == t]) for t in "abcde"}


def test_visited_nodes(spark):
    slots = spark.createDataFrame([(K0, "C" * 60 + "EEB1", bytes([1, 2, 3])), (K0, "C" * 60 + "EEB2", bytes([10, 20, 30]))], "account string, slot string, value binary")
    seen = {(r.is_storage, r.path, r.kind): (r.level, r.hash is None) for r in tries.visit(accounts(spark, (K0, 0, 1), (K1, 1, 1)), slots).collect()}
    assert seen == {
        (False, "", "extension"): (0, False), (False, "0", "branch"): (1, False), (False, "00", "leaf"): (2, False), (False, "01", "leaf"): (2, False),
        (True, "", "extension"): (0, False), (True, "C" * 60 + "EEB", "branch"): (1, True), (True, "C" * 60 + "EEB1", "leaf"): (2, True), (True, "C" * 60 + "EEB2", "leaf"): (2, True),
    }


def test_accessor_follows_the_chain(spark, tmp_path):
    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/a", history=2))
    parent = EMPTY
    for n in range(1, 6):
        block = chain.start(parent)
        block.set_account(K0, n, n)
        block.setter(K0)(K1, bytes([n]))
        parent = block.commit(n, f"s{n}")
    fork = chain.start("s1")
    fork.set_account(K0, 99, 99)
    fork.commit(2, "fork")
    reads = chain.accessor()
    assert reads.get_account("fork", K0) == (99, 99) and reads.get_account("s4", K0) == (4, 4) and reads.get_account("none", K0) == (0, 0)
    chain.finalize("s4")
    assert sorted(reads.hashes()) == ["s3", "s4", "s5"]  # the fork went, and what the history doesn't keep
    asked = spark.createDataFrame([(h, K0, K1) for h in ("s1", "s3", "s4", "s5", "fork")], "state_hash string, account string, slot string")
    assert {r.state_hash: bytes(r.value) for r in reads.storage(asked).collect()} == {"s1": b"", "s3": b"\x03", "s4": b"\x04", "s5": b"\x05", "fork": b""}
    assert {r.state_hash: int.from_bytes(r.nonce, "big") for r in reads.accounts(asked.drop("slot")).collect()} == {"s1": 0, "s3": 3, "s4": 4, "s5": 5, "fork": 0}


def test_raw_state_with_proofs(spark, tmp_path):
    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/raw"))
    raw = chain.start_raw()
    kids = {f"{i:X}": bytes([i]) * 32 for i in range(16)}
    raw.create_branch("", "0", kids, persist=False)
    ref = bytes(raw.nodes.first().ref)
    body = b"".join(b"\xa0" + h for h in kids.values()) + b"\x80"
    from lodestate.functions.keccak import keccak256_many

    assert ref == keccak256_many([b"\xf9" + len(body).to_bytes(2, "big") + body])[0]
    assert not raw.is_persisted("", "0") and raw.process_proofs() == []
    for i, (k, h) in enumerate(kids.items()):
        raw.nodes = raw.nodes.unionByName(tries.synced_leaves(spark.createDataFrame([("", f"0{k}", "1")], "account string, path string, node_path string")).withColumn("ref", F.lit(h)))
    assert raw.process_proofs() == ["0"] and raw.is_persisted("", "0") and raw.is_persisted("", "0", ref) and not raw.is_persisted("", "0", b"x" * 32)
    raw.create_extension("", "", "0", ref)
    assert raw.is_persisted("", "")
    raw.set_account(K0, 13, 23)
    assert raw.commit() == ROOTS[0][1] == raw.seal(1)
    assert chain.latest().get_account(K0) == (13, 23)


def test_import_in_blocks(spark, tmp_path):
    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/imp", history=3))
    rows = [("", i, 0, 1, K0, f"{i % 7:02X}", bytes([i]), 0) for i in range(50)]
    ops = spark.createDataFrame(rows, "block_hash string, seq long, op int, type int, account string, slot string, value binary, entry_type int")
    assert chain.import_blocks(ops, 5, lag=4) == 10
    assert chain.finalized == ("import-6", 6) and list(chain.blocks) == [f"import-{n}" for n in range(7, 11)]
    assert {r.slot: r.value[0] for r in chain.view("import-10").storage().collect()} == {f"{i % 7:02X}": i for i in range(50)}
    assert {r.slot: r.value[0] for r in chain.latest().storage().collect()} == {f"{i % 7:02X}": i for i in range(30)}


def test_writers_exclude_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    state = spark.createDataFrame([(K0, "", 0, b"\x01")], "account string, slot string, type int, value binary")
    one, two = SnapshotStore(spark, path), SnapshotStore(spark, path)
    with one._writing(), pytest.raises(RuntimeError):
        two.commit(state, 1, "h")
    assert one.vacuum() == 0
    one.commit(state, 1, "h1", flush=one.NO_WRITE)
    assert one.pending() == ["h1"] and two.latest() is None
    one.commit(state, 2, "h2", flush=one.DATA_ONLY)
    assert two.latest() is None
    one.flush()
    assert [r.state_hash for r in two._rows()] == ["h2", "h1"] and one.pending() == []
    two.commit(state, 3, "h3")
    state.write.parquet(f"{path}/versions/left-behind")
    assert two.vacuum() == 2 and two.vacuum() == 0
    assert [r.state_hash for r in one._rows()] == ["h3", "h2"] and one.read("h2").count() == 1
    assert len(list((tmp_path / "w" / "manifest").glob("*.parquet"))) == 1
    assert sorted((r.batch_id, r.entries) for r in one.parts().collect()) == [(2, 1), (3, 1)]


def test_metrics(spark, tmp_path):
    from lodestate.plans import metrics

    df, watch = metrics.observed(spark.range(10), rows=F.count(F.lit(1)), highest=F.max("id"))
    df.write.parquet(f"{tmp_path}/m")
    assert watch.get == {"rows": 10, "highest": 9}
    listener = metrics.StreamMetrics()
    for i, v in enumerate((3, 1, 2)):
        listener.record(i, "reads", v)
    row = listener.table(spark).first()
    assert (row["last"], row.total, row.samples, row.p50, row.highest) == (2.0, 6.0, 3, 2.0, 3.0)


def test_command_line(spark, tmp_path, capsys):
    from lodestate.__main__ import main

    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/cli"))
    block = chain.start()
    block.set_account(K0, 13, 23)
    block.set_account(K1, 17, 29)
    chain.finalize(block.commit(1))
    assert main(["verify", f"file://{tmp_path}/cli"]) == 0 and ROOTS[4][1] in capsys.readouterr().out
    assert main(["stats", f"file://{tmp_path}/cli"]) == 0 and main(["storage", f"file://{tmp_path}/cli"]) == 0
    assert "extension" in capsys.readouterr().out


def test_commits_hash_what_they_change(spark, tmp_path):
    """Roots after sets, deletes, destroys and prefix deletes equal those of the whole state."""
    import random

    r = random.Random(6)
    key = lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(64))
    chain = Chain(SnapshotStore(spark, f"file://{tmp_path}/inc", history=4))
    accounts_, slots, parent = [key() for _ in range(30)], [key() for _ in range(12)], EMPTY
    for n in range(1, 5):
        block = chain.start(parent)
        for a in r.sample(accounts_, 12 if n == 1 else 4):
            block.set_account(a, r.randrange(1, 10**9), n)
            for slot in r.sample(slots, 6):
                block.set_storage(a, slot, bytes([r.randrange(1, 255)]) if r.random() < 0.8 else b"")
        if n == 2:
            block.destroy_account(accounts_[0])
            block.destroy_account(sorted(x.account for x in chain.view(parent).accounts().collect())[0])
        if n == 3:
            block.delete_by_prefix(accounts_[3][0])
            block.delete_by_prefix(slots[0][0], sorted(x.account for x in chain.view(parent).storage().select("account").distinct().collect())[0])
        before = chain.roots.get(parent)
        parent = block.commit(n)
        assert parent == chain.view(parent).root() and (before is not None) == (n > 1)
    assert chain.finalize(parent) and set(chain.roots) <= {x.state_hash for x in chain.store._rows()}


def test_predecessors_far_apart(spark):
    members = [-(1 << 50), -5, 3, (1 << 41) + 7, 1 << 55]
    asked = [-(1 << 51), -(1 << 50), -6, -5, 2, 3, 1 << 30, (1 << 41) + 6, (1 << 41) + 8, (1 << 60)]
    found = stats.highest_not_above(spark.createDataFrame([(m,) for m in members], "v long"), spark.createDataFrame([(q,) for q in asked], "q long"), "v", "q")
    assert {r.q: r.v for r in found.collect()} == {q: max((m for m in members if m <= q), default=None) for q in asked}


def _join_inputs(plan):
    """Types of the columns that reach each join of a logical plan from its left."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [[plan.left().output().apply(i).dataType().simpleString() for i in range(plan.left().output().size())]] if plan.nodeName() == "Join" else []
    return own + [x for child in below for x in _join_inputs(child)]


def test_filter_lookups_carry_no_bitmaps(spark):
    hash_ = F.xxhash64("id")
    for bits in (1 << 16, filters.BROADCAST * 2):
        has = filters.union(filters.build(spark.range(0, 3000, 3), hash_, bits), filters.build(spark.range(1, 3000, 3), hash_, bits))
        found = filters.may_contain(spark.range(3000), has, F.xxhash64(F.lit("absent")), hash_, bits=bits)
        inputs = _join_inputs(found._jdf.queryExecution().optimizedPlan())
        assert len(inputs) == 2 and not any("binary" in types for types in inputs)
        rows = {r.id: r.may_contain for r in found.collect()}
        assert len(rows) == 3000 and all(rows[i] for i in range(3000) if i % 3 < 2)
        assert sum(rows[i] for i in range(2, 3000, 3)) <= (100 if bits == 1 << 16 else 5)
        both = filters.may_contain(spark.range(2, 3000, 3), has, hash_, F.xxhash64(F.lit(0).cast("long")), bits=bits)
        assert both.where("not may_contain").count() == 0  # the second hash is that of a member


def test_predecessors_of_repeated_values(spark):
    members = spark.range(200_000).select((F.col("id") % 5 * 10).alias("v"))
    queries = spark.createDataFrame([(q,) for q in [-1, 7, 7, 7, 40, 41, None] + [25] * 2500], "q long")
    found = stats.highest_not_above(members, queries, "v", "q")
    counts = {tuple(r)[:2]: r["count"] for r in found.groupBy("q", "v").count().collect()}
    assert counts == {(-1, None): 1, (7, 0): 3, (40, 40): 1, (41, 40): 1, (None, None): 1, (25, 20): 2500}
    # what is sorted are distinct values: there is an aggregation below each window
    windows = [x for x in _plans(found._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Window"]
    assert windows and all(any(y.nodeName() == "Aggregate" for y in _plans(x)) for x in windows)


def _plans(plan):
    return [plan] + [x for i in range(plan.children().size()) for x in _plans(plan.children().apply(i))]


@pytest.mark.parametrize("subtrie", [1 << 15, 30])
def test_levels_of_nodes_come_with_the_parts(spark, leaves, subtrie):
    table = spark.createDataFrame(leaves, "trie string, path string, value binary").repartition(3)
    nodes = tries.reduced(table, keep=True, subtrie=subtrie)[1].collect()
    forks = {(r.trie, r.path, r.kind) for r in nodes if r.kind != "leaf"}
    up = lambda r: sum((r.trie, r.path[:n], k) in forks for n in range(len(r.path) + 1) for k in ("branch", "extension")) - (r.kind != "leaf")
    assert len(nodes) > 400 and [r.level for r in nodes] == [up(r) for r in nodes]
