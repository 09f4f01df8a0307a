"""The pipeline's stages, each on its own input, against brute force; and the registered queries."""

import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

pipeline = pytest.importorskip("corpus_pipeline")
from textloom.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, after := spark.read.parquet(path)))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(steps):
    for name, (before, after) in steps.items():
        if name != "packing":
            assert after.columns == before.columns and after.schema["doc_id"].dataType == before.schema["doc_id"].dataType


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(texts(after)) == sorted((r["doc_id"], r["text"]) for r in scored.where("predicted = 0").collect())
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in texts(after)}
    clean = [i for i, _ in texts(before) if truth.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_line_dedup(steps):
    before, after = steps["line_dedup"]
    assert dict(texts(after)) == {i: kept for i, (_, _, kept) in brute.line_dedup(texts(before)).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_ngram_join(steps):
    before, after = steps["ngram_join"]
    keep = {i for i, _, component, _ in brute.components(texts(before)) if i == component}
    assert sorted(texts(after)) == sorted((i, t) for i, t in texts(before) if i in keep)


def test_substring_dedup(steps):
    before, after = steps["substring_dedup"]
    want = brute.substring_dedup(texts(before))
    assert dict(texts(after)) == {i: want[i][2] if want[i][1] else t for i, t in texts(before)}


def test_packing(steps):
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    tokenizer, docs, seen = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), dict(texts(before)), {}
    for r in after.collect():
        ids = [*tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert set(seen) == set(docs)


def test_ngram_join_keeps_one_of_each_group(spark):
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(1, words), (1, words), (2, words), (None, words + " more"), (None, None), (None, ""), (None, "a lone text"), (3, "another"), (4, "ANOTHER"), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.ngram_join(spark, docs, SF)
    assert sorted(texts(out), key=repr) == sorted([(1, words), (None, None), (None, ""), (None, "a lone text"), (3, "another"), (None, "twice")], key=repr)


def test_run(spark, steps):
    assert pipeline.run(spark, SF).count() == steps["packing"][1].count()


def test_edges(spark, edges, nothing):
    for docs in (edges, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns and n <= docs.count()
            if name in ("line_dedup", "substring_dedup"):
                assert n == docs.count()


def test_queries_match_duckdb(spark):
    import duckdb

    from textloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(theirs, key=repr), name


def test_queries_without_sql(spark):
    """Those that SQL cannot express, as registered, against brute force on the smallest tables."""
    from textloom.llm import queries

    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert got == {i: (n, g, brute.sha(k)) for i, (n, g, k) in brute.substring_dedup(docs).items()}
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in queries.op3_ngram_join(spark, SF).collect()}
    assert got == set(brute.components(docs))
    assert {r["doc_id"] for r in queries.op4_toxicity(spark, SF).collect()} == {i for i, _ in docs}
    near = queries.op7_fingerprints(spark, SF).agg({"near_edited": "avg", "near_next": "avg"}).first()
    assert near[0] != near[1]


def test_tokens_of_the_registered_queries(spark):
    """op2 and op5 as registered, against the tokenizers library."""
    from tokenizers import Tokenizer

    from textloom.llm import queries

    docs = dict(texts(spark.read.parquet(f"{SF}/documents.parquet")))
    words, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for tokenizer in (words, pieces):
        tokenizer.no_truncation()
        tokenizer.no_padding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op5_bpe(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = words.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(words.decode(ids, skip_special_tokens=False)))
    seen = dict.fromkeys(docs, 0)
    for r in queries.op2_packing(spark, SF).collect():
        ids = [*pieces.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        seen[r["doc_id"]] += r["length"]
        if seen[r["doc_id"]] == len(ids):
            seen.pop(r["doc_id"])
    assert not seen
