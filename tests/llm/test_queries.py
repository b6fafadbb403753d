import hashlib
import io
import wave
import zlib

import duckdb
import numpy as np
import pytest

from lodestate.llm import bpe

from lodestate.llm import queries as Q

from ..test_queries import SF, TABLES, rows
from . import brute
from .test_operators import ITEMS, corpus


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert rows(got) == rows(want[list(got.columns)])


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = Q.op9_language(spark, SF).join(docs, "doc_id").where("held_out and lang is not null and lang_pred != 'und'").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97


def test_held_out_toxicity(spark):
    """Of the rows that weren't learned from."""
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    found = Q.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    toxic = found[found["toxic"] == 1]
    assert found[found["toxic"] == 0]["predicted"].mean() < 0.03 and toxic["predicted"].mean() > 0.6


def test_media_query(spark):
    """Every column of the query against plain code."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op10_media(spark, SF).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        if len(payload) < 20_000:
            codes = brute.fingerprint(payload)
            assert r.codes == codes and r.feature == hashlib.sha256(np.array(codes, "<i8").tobytes()).hexdigest()[:32]


def test_near_duplicate_and_repeat_queries(spark):
    """op4 and op6 on the whole test table against brute force."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in Q.op6_near_dedup(spark, SF).collect()) == brute.near_duplicates(texts)
    assert sorted(tuple(r) for r in Q.op4_suffix_dedup(spark, SF).collect()) == brute.remove_repeats(texts)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(d, t, ("en", None)[d % 2], "web", 0) for d, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(d, t) for d, t in corpus() if t and any(c.isalpha() for c in t)]
    kept = [(d, dict(kept)[d]) for d, _, _, first in brute.near_duplicates(kept, 80) if first]
    kept = [(d, b.decode("utf-8", "ignore")) for d, _, _, _, b in brute.kept_bytes(kept)]
    clean = {d for d, _, hit, _ in brute.contamination(kept, ITEMS) if not hit}
    plain = Tokenizer.from_file(bpe.default_path())
    ids = {d: np.array(plain.encode(t, add_special_tokens=False).ids, "<u4") for d, t in kept if d in clean}
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == sorted((d, len(i), hashlib.sha256(i.tobytes()).hexdigest()) for d, i in ids.items())
    assert all(r.exact and r.lang == "en" for r in out) and 0 < len(out) < len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
