import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestate.llm import bpe, chat, decontam, langid, media, minhash, suffix_dedup, token_counts, toxicity, warc
from lodestate.llm._batches import blocks, stored, text_view, word_spans
from lodestate.llm.lyndon import suffix_array

from . import brute

WORDS = "the of and river stone light under green walks seven paper never blue mountain city old bridge rain door music winter road".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ","]) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, characters of several bytes."""
    base, passage, long_ = prose(1, 300), prose(2, 60), prose(3, 9000)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, base), (5, base), (6, long_), (7, edited(long_, 4, 40))]
    rows += [(10 + i, edited(base, i, i)) for i in range(24)]
    rows += [(40 + i, prose(100 + i, 80) + " " + passage + " " + prose(200 + i, 50)) for i in range(20)]
    rows += [(70, "é" * 120), (71, "z" + "é" * 90), (72, "same " * 200), (73, "same " * 100), (74, passage), (75, passage[:49]), (76, "\x00" * 80), (77, "日本語テキスト" * 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"n{i}", i) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, row int").repartition(5)


def test_word_spans_stop_at_borders():
    raw, at = text_view(pa.array(["ab", None, "c d", ""]))
    starts, ends, rows = word_spans(raw != 32, at)
    assert list(zip(starts, ends, rows, strict=True)) == [(0, 2, 0), (2, 3, 2), (4, 5, 2)]


def test_blocks_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + ["b" * 99])], ["text"])
    assert [b.num_rows for b in blocks(iter([batch]), "text", 25)] == [2, 2, 2, 1, 1]


def test_suffix_array_by_grouping():
    r = random.Random(5)
    for n in [0, 1, 2, *range(3, 60)]:
        x = [r.randint(1, r.choice([1, 2, 4, 50])) for _ in range(n)]
        assert list(suffix_array(np.array(x, np.int64))) == sorted(range(n), key=lambda i: x[i:])


def test_near_duplicates(docs):
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == brute.near_duplicates(corpus())


def test_components_by_rounds_equal_one_task(spark):
    r = random.Random(7)
    links = stored(spark.createDataFrame([(i, r.randrange(i)) for i in range(1, 300) if i % 5], "a long, b long"), "test")
    nodes = spark.range(300).withColumnRenamed("id", "doc_id")
    assert sorted(minhash.components(nodes, links).collect()) == sorted(minhash.components(nodes, links, local_links=0).collect())


def test_residual_links_in_blocks(spark):
    """A family that no single star connects, over several blocks."""
    base = prose(11, 120)
    rows = [(i, edited(base, i, 2 + i % 9)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = docs.select("doc_id", F.lit(116).cast("long").alias("n"), F.lit(0).cast("long").alias("family"))
    parts = docs.select("doc_id", F.col("doc_id").alias("component_id"))
    links = stored(minhash.residual_links(minhash.open_blocks(members, parts, block=16), docs, percent=85), "test")
    got = sorted(tuple(r) for r in minhash.components(docs.select("doc_id"), links).collect())
    assert got == [(d, c) for d, _, c, _ in brute.near_duplicates(rows)]


def thue_morse(a, b, size=2048):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(size))


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    """Words whose polynomial hashes modulo 2**64 are equal for any multiplier share nothing."""
    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    rows = [(1, " ".join([x] * 9)), (2, " ".join([y] * 9)), (3, f"{x} {y} {x} {x} {y}"), (4, f"{y} {x} {y} {y} {x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == brute.near_duplicates(rows)
    found = decontam.contamination(docs, spark.createDataFrame([(7, " ".join([y] * 10)), (8, f"{x} {y}")], "item_id int, text string"))
    assert sorted((r.row.doc_id, r.n_hit, sorted(r.item_ids)) for r in found.collect()) == [(1, 0, []), (2, 0, []), (3, 4, ["8"]), (4, 2, ["8"])]


def test_one_layout_makes_no_blocks(spark):
    """Documents that share three quarters of their text and no link: what is compared grows in proportion."""
    layout = prose(77, 300).split()

    def page(i):
        r = random.Random(i)
        return " ".join(layout[:150] + [f"w{r.randrange(10**9)}" for _ in range(100)] + layout[150:])

    docs = spark.createDataFrame([(i, page(i)) for i in range(400)], "doc_id long, text string")
    lists = minhash.fine_lists(docs, docs, percent=85)
    assert lists.count() == 0
    assert minhash.near_duplicates(docs).where("not kept").count() == 0


def test_repeated_and_missing_ids(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(1, a), (2, b), (5, a), (5, b), (5, b), (6, c), (None, c), (None, None), (7, None)]
    got = sorted(((r.doc_id or 99), r.component_id or 99, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (5, 1, False), (6, 6, True), (7, 7, True), (99, 99, True), (99, 99, True)]


def test_shared_shingles_by_words():
    r = random.Random(8)
    for n in (*range(8), 30, 200):
        x, y = ([r.choice("abcd") for _ in range(n)] for _ in range(2))
        x = x[: r.randrange(n + 1)] if n % 3 == 0 else x
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (x, y)]
        assert minhash.shared_shingles(" ".join(x).encode(), " ".join(y).encode()) == (len(sets[0] & sets[1]), len(sets[0] | sets[1]))


def altered(percent, n):
    """n pairs of texts of 400 words, of a Jaccard little above percent / 100."""
    rows = []
    for i in range(n):
        w = [f"a{i}x{j}" for j in range(400)]
        size = len(w) - 4
        gone = int(size * (100 - percent) / (100 + percent))  # one changed word in the middle changes 5 shingles
        changed = list(w)
        for j in range(gone // 5):
            changed[4 + 5 * j] = f"b{i}x{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
    return rows


def test_overlap_follows_percent(spark):
    assert [minhash.overlap_of(p) for p in (85, 80, 70)] == [39, 34, 26]
    with pytest.raises(ValueError):
        minhash.overlap_of(15)
    rows = altered(70, 150)
    want = brute.near_duplicates(rows, 70)
    assert sum(not r[3] for r in want) == 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs, percent=70).collect()) == want


def test_pipeline_drops_documents_of_80_percent(spark):
    import corpus_pipeline

    rows = altered(81, 20)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert not any(not r[3] for r in brute.near_duplicates(rows, 85))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [r[0] for r in brute.near_duplicates(rows, 80) if r[3]] == list(range(0, 40, 2))


def test_remove_repeats(docs):
    got = suffix_dedup.remove_repeats(docs)
    assert sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute.remove_repeats(corpus())
    assert got.where("n_removed = 0").where("coalesce(kept, '') != '' and length(kept) = 0").count() == 0


def test_repeated_rows_are_kept(spark):
    text = prose(21, 40)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.row.doc_id or 99, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(text)), (99, len(text))]
    assert sorted((r.doc_id or 99, r.component_id or 99) for r in minhash.near_duplicates(docs.where("doc_id is not null")).collect()) == [(1, 1), (1, 1), (2, 1)]


def removed(spark, rows, **options):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options)
    return sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())


def test_context_digests_tell_contexts_apart():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(200)) for _ in range(40)] + [b"x" * 200, b"x" * 60]
    raw, offsets = text_view(pa.array([t.decode() for t in texts]))
    at = np.concatenate([np.arange(a, b - suffix_dedup.ANCHOR + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    _, left, right = suffix_dedup._context_bounds(at, offsets)
    digests = np.stack(suffix_dedup.context_digests(raw, at, left, right), 1)
    whole = [(raw[a:b].tobytes(), int(p - a)) for p, a, b in zip(at, left, right, strict=True)]
    assert len({tuple(x) for x in digests.tolist()}) == len(set(whole)) == len(dict(zip(whole, map(tuple, digests.tolist()), strict=True)))


def test_crowded_anchors_and_periods(spark):
    """Every way that contexts can take, and periodic texts, of which few anchors are kept."""
    rows = corpus() + [(100 + i, ("ab" * (i * 17 + 3) + prose(i, 5) + "-" * (40 * i)) * 2) for i in range(8)] + [(120, "abc" * 500), (121, "cab" * 30), (122, "=" * 3000 + "end"), (123, "new" + "=" * 300)]
    want = brute.remove_repeats(rows)
    assert removed(spark, rows) == removed(spark, rows, hot=1) == removed(spark, rows, bucket_rows=1) == want
    raw, offsets = text_view(pa.array(["=" * 100_000]))
    assert len(suffix_dedup.anchors(raw, offsets)[0]) < 5000


ITEMS = [(1, prose(2, 60)[30:200]), (2, "never blue"), (3, None), (4, ""), (5, "Mountain!"), (6, prose(300, 30)), (7, prose(300, 30)), (8, "river stone light, under")]


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontam.contamination(docs, items).collect())
    assert got == brute.contamination(corpus(), ITEMS)
    split = sorted((r.row.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontam.contamination(docs, items, block_bytes=100).collect())
    assert split == got
    assert decontam.decontaminate(docs, items).columns == docs.columns
    assert decontam.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    texts = {d: t or "" for d, t in corpus()}
    for chunk in (8, 512):
        for r in bpe.encode(docs, decoded="back", chunk_bytes=chunk).collect():
            ids = plain.encode(texts[r.row.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
            assert r.back == plain.decode(ids, skip_special_tokens=False) == texts[r.row.doc_id]
    coded = bpe.encode(docs)
    assert {r.row.row.doc_id: r.decoded for r in bpe.decode(coded).collect()} == texts


def test_bpe_special_strings_and_spaces(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext", " " * 900 + "x", "it's  we'll\n\n\t y", "x" * 5000, "ab " * 3000]
    codec = bpe.Codec(*bpe.read_vocabulary(bpe.default_path()), chunk_bytes=16, cache_bytes=2000)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_rows(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    flat = stored(token_counts.write_tokens(docs, block_tokens=64), "test")
    counts = token_counts.scan_tokens(flat, 50256).join(token_counts.document_keys(flat), ["shard", "document"])
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == [(d, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in corpus()]


def test_media(docs):
    seen = {}
    for r in media.media_features(media.store_media(docs).select("row.doc_id", "row.text", "n_bytes", "media"), keep=["doc_id", "text", "n_bytes"]).collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert seen.setdefault(r.text or "", r.feature) == r.feature and r.codes == sorted(r.codes)
    assert len({f for t, f in seen.items() if len(t) > 500}) == len([t for t in seen if len(t) > 500])


def test_fingerprints_equal_the_plain_version():
    for text in ("", "a", prose(5, 12), prose(6, 400), "x" * 1000, "日本語" * 90):
        samples = media.payload_of(text.encode())
        assert media.fingerprint(samples).tolist() == brute.fingerprint(samples)


def test_media_parts_agree(monkeypatch):
    samples = prose(9, 800).encode()
    whole = media.fingerprint(samples)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert (media.fingerprint(samples) == whole).all()


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "large " * 5000
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "v", ""), (5, "w", "tiny"), (6, "w", "tiny"), (7, "é", "ü" * 60), (7, "é", "ü" * 60), (9, "q", "ü" * 60)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record int")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, chunk_bytes=64)
    rows += [(None, "n", big), (8, "s", "ü" * 60 + "x")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record int")
    path = f"file://{tmp_path}/w2"
    warc.write_archives(pages, path, chunk_bytes=64)
    assert spark.read.parquet(path).where("octet_length(data) > 64 + 400").count() == 0
    got = list((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.read_archives(spark.read.parquet(path)).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    refers = {2: 1, 9: 7}
    assert sorted(map(repr, got)) == sorted(repr((p, len((h or "").encode()), digest(h), "revisit" if p in refers else "response", refers.get(p), True)) for p, _, h in rows)


def test_chat_round_trip_and_order(spark):
    nasty = ["### ", "\\h", "a: b", " </turn>\n", "\\", "", None, "</turn", "\\b\\t", "###: "]
    rows = [(c, t, ["user", "assistant"][t % 2], x) for c, x in enumerate(nasty) for t in range(2)] + [(20, 1, "assistant", "x"), (21, 1, "ro: le\\", "y"), (22, 1, None, "z"), (23, 2, "assistant", "b"), (23, 1, "user", "a"), (23, 2, "assistant", "b")]
    chats = chat.format_chats(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, segments int"))
    back = {r.conv_id: r for r in chats.select("*", chat.read_turns(F.col("formatted")).alias("turns")).withColumns({"loss": chat.loss_text(F.col("turns")), "masked": chat.escape(chat.loss_text(F.col("turns")))}).collect()}
    for c in {r[0] for r in rows}:
        turns = [((r[2] or ""), r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss == "".join(t for role, t in turns if role == "assistant")
        assert back[c].formatted == "".join(s.text for s in back[c].segments)
        assert "".join(s.text for s in back[c].segments if s.loss) == back[c].masked
    assert back[0].in_order and not back[20].in_order and not back[21].in_order and not back[23].in_order


def test_chat_rows_without_a_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    got = sorted((r.conv_id or 0, r.n_turns) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    assert got == [(0, 1), (0, 2), (1, 1)]


def test_templates_that_cannot_be_read_back():
    for options in ({"opening": "@@ "}, {"closing": "</end>"}, {"after_role": ":: "}, {"escapes": (("###", "\\h"),)}):
        with pytest.raises(ValueError):
            chat.Template(**options)
    chat.Template(opening="@@ ", escapes=(("\\", "\\b"), ("@@", "\\h"), ("</turn>", "\\z"), (": ", "\\c")))


def test_chat_plan_is_native(spark):
    from lodestate.llm import queries

    plan = queries.op1_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_grammar_composition():
    rules = toxicity.grammar()
    run = lambda symbols: "".join(rules.read(list(symbols))[0])
    assert run("I") == "a" and run("GOI")[-1] == "b" and run("NI")[-1] == "c" and run("ROOOOOI")[-1] == "d"
    assert run("NOOOOOI")[-1] == "a" and run("RT")[-1] == "h" and run("GT")[-1] == "f"
    assert run("TG") == "fG" and run("NTG")[1] == "g" and run("ROIG")[2] == "d" and run("IOOOOOG")[0] == "a"


def test_clauses_are_scored_by_their_path():
    rules, w = toxicity.grammar(), toxicity.PRIOR
    value = lambda symbols: float(rules.read(list(symbols))[1] @ w[:9])
    assert value("OOG") == 0 and value("I") == w[0] + w[8] and value("GI") == w[0] + w[2] + w[8]
    assert value("NI") == w[0] + w[4] < value("I") and value("RI") == w[0] + w[6] and value("GNI") == w[0] + w[2] + w[4]
    assert value("TG") == w[1] + w[3] + w[8] > value("T") == w[1]


def test_toxicity(spark):
    clean = [(i, prose(i, 60) + ".", 0) for i in range(120)]
    toxic = [(200 + i, prose(300 + i, 30) + ". " + " ".join(f"{prose(i + k, 3)} zorg{'abcdef'[k]} {prose(k, 2)}." for k in range(3)), 1) for i in range(60)]
    rows = clean + toxic
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 3] + [(0, None)], "doc_id long, toxic int")
    found = {r.row.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((found[d] >= 0.5) == bool(y) for d, _, y in rows)
    assert found[900] == found[901] < 0.5
    plain = toxicity.train(docs, labels.limit(0))
    scored = {r.row.text: r.score for r in toxicity.score(spark.createDataFrame([("you idiot and moron",), ("he said: fine",)], "text string"), plain).collect()}
    assert scored["you idiot and moron"] >= 0.5 > scored["he said: fine"]


def test_language(spark):
    rows = [(i, "the river and the stone walk under the light " * 3, "en") for i in range(30)] + [(50 + i, "der fluss und die steine gehen unter das licht " * 3, "de") for i in range(30)]
    train = spark.createDataFrame(rows + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(train, order_by="doc_id")
    asked = spark.createDataFrame([(1, "stone and light", 0.5), (2, "die steine und licht", 0.5), (3, None, 0.5), (4, "", 0.5), (5, "12 34 !!", 0.5)], "doc_id long, text string, score double")
    assert {r.row.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert sorted(r.doc_id for r in langid.keep_identified(asked, model).collect()) == [1, 2]
    labelled = spark.createDataFrame([(1, "stone and light", None), (2, "die steine und licht", "xx"), (3, "..", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in langid.keep_identified(labelled, model, lang="lang").collect()} == {1: "en", 2: "xx"}
    assert langid.predict(asked.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(asked, langid.train(train.limit(0))).collect()} == {"und"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert minhash.near_duplicates(none).count() == suffix_dedup.remove_repeats(none).count() == bpe.encode(none).count() == 0
    assert decontam.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert media.store_media(none).count() == 0 and toxicity.score(none, toxicity.Model.seeded(np.zeros(0, np.uint64))).count() == 0
    assert token_counts.scan_tokens(stored(token_counts.write_tokens(none), "test"), 50256).count() == 0
    pages = warc.chunk_rows(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.to_records(pages, warc.plan_revisits(pages)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_texts_of_many_megabytes(spark):
    """Texts of 3 and 20 MB, far above any block, and a copy of the smaller one."""
    from tokenizers import Tokenizer

    def long(seed, size):
        r = random.Random(seed)
        names = [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(40_000)]
        out = " ".join(r.choices(names, k=size // 10))
        return (out + " " + " ".join(r.choices(names, k=size // 10)))[:size]

    three, twenty = long(1, 3 << 20), long(2, 20 << 20)
    rows = [(1, three), (2, twenty), (3, three + " you worthless idiot."), (4, "short text of no weight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.row.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: len(three), 4: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    item = " ".join(twenty.split()[1_000_000:1_000_012])
    assert {r.row.doc_id: r.n_hit for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()} == {1: 0, 2: 12, 3: 0, 4: 0}
    plain = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode(docs.where("doc_id != 2"), decoded="back").collect():
        text = dict(rows)[r.row.doc_id]
        assert r.back == text and np.frombuffer(bytes(r.ids), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    scores = {r.row.doc_id: r.score for r in toxicity.score(docs, toxicity.Model.seeded(np.zeros(0, np.uint64))).collect()}
    assert scores[3] > 0.5 > scores[2] == scores[4]
    model = langid.train(spark.createDataFrame([("the river and the stone " * 9, "en"), ("der fluss und der stein " * 9, "de")], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"en"}
    found = {r.doc_id: (r.payload_bytes, r.payload_sha256) for r in media.media_features(media.store_media(docs).select("row.doc_id", "media"), keep=["doc_id"], codes=False).collect()}
    assert found[2] == (20 << 20, hashlib.sha256(twenty.encode()).hexdigest())
    flat = stored(token_counts.write_tokens(docs.where("doc_id in (1, 4)")), "test")
    counts = {r.doc_id: r.n_tokens for r in token_counts.scan_tokens(flat, 50256).join(token_counts.document_keys(flat), ["shard", "document"]).collect()}
    assert counts[1] == len(plain.encode(three, add_special_tokens=False).ids)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    path = warc.archive_path(spark, "long")
    warc.write_archives(pages, path)
    assert spark.read.parquet(path).agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK_BYTES + 4
    assert {r.page_id: (r.payload_bytes, r.intact) for r in warc.read_archives(spark.read.parquet(path)).collect()} == {d: (len(t), True) for d, t in rows}
    turns = spark.createDataFrame([(1, 0, "user", three), (1, 1, "assistant", twenty)], "conv_id long, turn int, role string, text string")
    back = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("t")).select(F.transform("t", lambda t: F.sha2(t["text"], 256)).alias("h")).first().h
    assert back == [hashlib.sha256(t.encode()).hexdigest() for t in (three, twenty)]


def test_language_counts_take_little_memory():
    import tracemalloc

    text = "eine kleine geschichte ohne ende und ohne anfang " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(["de", "en"] * 1000), pa.array([text] * 2000)], ["lang", "text"])
    tracemalloc.start()
    try:
        sums = pa.Table.from_batches(list(langid._counted(iter([batch])))).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sums[sums.bucket == -1].set_index("lang").n.to_dict() == {"de": 1000, "en": 1000}
    assert peak < 130 << 20
