"""The token store, the repair of conversations and the Merkle manifest against brute force, and on edge cases."""

import array
import functools
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from textloom.llm import conversation_repair, merkle, token_store

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def encoded(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def ordered(spark, docs):
    """(doc_id, text) in the store's order: nulls first, then by doc_id, repeated ones by a hash of the text."""
    keyed = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return [(r["doc_id"], r["text"]) for r in sorted(keyed.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]


def stored(spark, docs, folder, **sizes):
    return token_store.write_store(docs, BYTES, f"file://{folder}", **sizes)


def test_token_store(spark, corpus, edges, tmp_path):
    for k, docs in enumerate((corpus, [(r["doc_id"], r["text"]) for r in edges.collect()])):
        store = stored(spark, spark.createDataFrame(docs, "doc_id long, text string") if k == 0 else edges, tmp_path / str(k), part_bytes=20_000, shard_bytes=3000, bucket_keys=16)
        want, start, copies = [], 0, Counter()
        for doc_id, text in ordered(spark, docs):
            ids = array.array("I", encoded(text))
            want.append((doc_id, copies[doc_id], start, len(ids), zlib.crc32(ids), ids.tobytes()))
            start += len(ids)
            copies[doc_id] += 1
        got = [(*r[:5], bytes(r["ids"])) for r in store.documents(store.keys(), keep_ids=True).collect()]
        assert Counter(got) == Counter(want)
        for row in random.Random(k).sample(want, 4):
            assert store.get(row[0], row[1]).astype("<u4").tobytes() == row[5]


def test_token_store_answers_for_keys_that_are_not_there(spark, corpus, tmp_path):
    store = stored(spark, spark.createDataFrame(corpus, "doc_id long, text string"), tmp_path / "s")
    asked = spark.createDataFrame([(k, c) for k in range(-50, 400) for c in (0, 1)] + [(None, 0)], "doc_id long, copy long")
    there = {i for i, _ in corpus}
    for r in store.located(asked).collect():
        assert (r["n"] is not None) == (r["doc_id"] in there and r["copy"] == 0)
    assert store.get(10**12) is None and store.get(None) is None


def test_token_store_with_one_doc_id_over_many_shards(spark, tmp_path):
    docs = [(7, f"text {k % 40}") for k in range(600)] + [(k, "x") for k in range(20)]
    store = stored(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), tmp_path / "s", part_bytes=400, shard_bytes=100, bucket_keys=50)
    assert store.manifest.count() > 12
    rows = store.documents(store.keys()).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((i, c) for i, n in Counter(i for i, _ in docs).items() for c in range(n))
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted(i for i, _ in docs)


def test_token_store_finds_damage(spark, corpus, tmp_path):
    store = stored(spark, spark.createDataFrame(corpus, "doc_id long, text string"), tmp_path / "s")
    for path in (tmp_path / "s" / "shards").glob("*.ids"):
        path.write_bytes(path.read_bytes()[:-2])
    with pytest.raises(Exception, match="does not hold"):
        store.documents(store.keys()).collect()


def test_token_store_of_nothing(spark, nothing, tmp_path):
    store = stored(spark, nothing, tmp_path / "s")
    assert store.documents(store.keys()).count() == 0 and store.get(1) is None


def reports(spark, rows, **sizes):
    """By conversation (the report, the repaired turns)."""
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, row string").repartition(3)
    found, turns = conversation_repair.repair(df, **sizes)
    said = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r["part"], r["at"])):
        said[r["conv_id"]].append((r["role"], r["text"]))
    return {r["conv_id"]: (tuple(r)[1:], said[r["conv_id"]]) for r in found.collect()}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
TEXTS = ["Fine.", "Is it?", "cut off", "", " \n", None, "Well!\x0b", "Aé.", "Fine."]


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 400, "least_parts": 7, "fan_in": 2}])
def test_repair(spark, sizes):
    rnd = random.Random(3)
    rows = [(c if c else None, rnd.choice([None, *range(9)]) if c % 3 == 0 else k, rnd.choice(ROLES), rnd.choice(TEXTS), 0, "x") for c in range(60) for k in range(rnd.randrange(1, 9))]
    rows += [(1000, k, ROLES[k % 5], f"text {k % 50}" + "." * (k % 7 > 0), 0, "x") for k in range(300)]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:4])
    got = reports(spark, rows, **sizes)
    assert got.keys() == by.keys()
    for c, own in by.items():
        assert got[c] == brute.repairs(own), c


def test_repair_of_texts_that_are_long_and_conversations_that_lost_all(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", "a."), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair(df, F.col("conv_id") != 2)[0].collect()}
    assert found[1] == brute.repairs([r[1:] for r in rows[:3]])[0]
    assert found[2] == (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    assert found[3] == (0, 1, 0, 0, 0, 3, "D", brute.sha(""))
    assert conversation_repair.repair(df.limit(0))[0].count() == 0


@given(st.text("xsuaoSUAO", max_size=9), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_products_do_not_depend_on_grouping(kinds, at):
    product = conversation_repair.product
    assert conversation_repair.times(product(kinds[:at]), product(kinds[at:])) == functools.reduce(conversation_repair.times, map(conversation_repair.turn_matrix, kinds), conversation_repair.ONE)


def damaged(conv_id, turn, role, text):
    role, text = role if role is not None else " ", text if text is not None else " "
    fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
    return [(conv_id, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t in (None, 0, 1) for r, x in (("user", "A. b!?"), (None, None))]
    turns, present = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(tuple(r)[:4] for r in turns.where(present).collect()) == Counter(y for x in rows for y in damaged(*x))


def proofs(spark, rows, arity, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, other string, tree string, pos int, digest string").repartition(3)
    steps = F.col("steps")
    found = merkle.merkle(df, arity, keep=("other",), **sizes).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(steps), merkle.folded(F.coalesce("other", "leaf"), steps))
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("arity,sizes", [(16, {}), (2, {"part_rows": 7}), (3, {"part_rows": 20})])
def test_merkle(spark, arity, sizes):
    rnd = random.Random(5)
    sources = [None, "", "a", "é", "z", "Z"] + ["hot"] * 6
    rows = [(rnd.choice([None, 5, *range(400)]), rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "Text é", "x" * 100_000 if k == 9 else "y"]), rnd.choice([None, "0" * 64]), "t", 1, "d") for k in range(260)]
    rows += [rows[3]] * 40 + [(1, "alone", "en", 1, "a", None, "t", 1, "d")]
    assert proofs(spark, rows, arity, **sizes) == Counter(brute.merkle([r[:6] for r in rows], arity))


def test_merkle_of_one_and_none(spark):
    row = (1, None, "en", 1, "a", None, "t", 1, "d")
    assert proofs(spark, [row], 16) == Counter(brute.merkle([row[:6]]))
    assert not proofs(spark, [], 16)


def test_merkle_of_many_groups(spark):
    rows = [(k % 3, f"s{k // 2}", None, None, "t", None, "t", 1, "d") for k in range(300)]
    assert proofs(spark, rows, 4, part_rows=30) == Counter(brute.merkle([r[:6] for r in rows], 4))
