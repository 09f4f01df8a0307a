"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

import functools
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from textloom.llm import bpe, chat_format, components, exact_dedup, fingerprints, line_dedup, ngram_join, packing, shared, substring_dedup, toxicity, warc
from textloom.llm.words import Words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a", "a  b", "a   b\n\n c", "x\n", "\nx", " x", "x ", "<|endoftext|>hi", "a\tb", "½ c²", "don't I'LL we've", "\x1c a", "日本 語", "a\n b", "ΣΑΣ ΣΣ x", "İstanbul", "<|startoftext|> b", "é é", "aaaa aaaaaaaaab", "ß STRASSE ﬁ", "123 4.5", "\x85 a", "Ᲊ ՘"]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_words():
    texts = ["", "a b", "  ", "é\x0bß\x1c y", "b a", "a b ", None or "\n", "zz"]
    w = Words(pa.chunked_array([pa.array(["skip", *texts]).slice(1)]))
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [brute.WORD.findall(t) for t in texts]


def twins(size):
    """Two words of letters a and b by the parity of a place's bits, one the other's complement: hashes that are polynomials modulo a power of two take them for one."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 100, 1024, 2048, 4096, 8192])
def test_words_are_told_apart(spark, size):
    x, y = twins(size)
    rest = " ".join(f"w{k}" for k in range(19))
    assert len(set(Words(pa.array([x, y, x + "a", "a" + x])).hash.tolist())) == 4
    docs = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    single = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(frame(spark, [(1, x), (2, y), (3, x)])).collect()}
    assert single == {1: 1, 2: 2, 3: 1}
    bag = toxicity.Bag([x, y, x])
    assert bag.distinct == 2 and bag.word[0] == bag.word[2] != bag.word[1]


def test_substring_dedup(spark, corpus):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, corpus), block_bytes=2000, bucket_bytes=2000).collect()}
    for i, (n, gone, kept) in brute.substring_dedup(corpus).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, brute.sha(kept))
        assert got[i]["text"] == (kept if gone else dict(corpus)[i])


def test_substring_dedup_without_ids(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(None, f"x{k} {passage}") for k in range(20)] + [(5, passage)]
    rows = substring_dedup.substring_dedup(frame(spark, docs)).collect()
    assert sorted(r["n_removed"] for r in rows) == [0] + [30] * 20
    assert [r["n_removed"] for r in rows if r["doc_id"] == 5] == [30]


def test_substring_dedup_does_not_depend_on_blocks(spark, corpus):
    """Rows without a doc_id, and repeated ones, give the same whether each is a block or all are one."""
    docs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t) for k, (i, t) in enumerate(corpus[-60:])]
    own = frame(spark, docs)
    found = [Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(own, block_bytes=b, bucket_bytes=8000).collect()) for b in (1000, 1 << 24)]
    assert found[0] == found[1] and sum(found[0].values()) == len(docs)
    rows = sorted((r["named"], r["rank"], r["text"]) for r in shared.blocks(own, 1, 1).collect())
    want = brute.substring_dedup(list(enumerate(t for _, _, t in rows)))
    assert Counter((n, gone, sha) for (_, n, gone, sha), times in found[0].items() for _ in range(times)) == Counter((n, gone, brute.sha(kept)) for n, gone, kept in want.values())


def test_substring_dedup_candidates_hold_all_repeats(corpus):
    words = Words(pa.array([t for _, t in corpus]))
    anchors = substring_dedup.Anchors(words, 20)
    valid = np.flatnonzero(words.runs(20))
    key = list(zip(*(x.tolist() for x in substring_dedup.window_digests(words, valid, 20)), strict=True))
    times = Counter(key)
    assert {i for i, k in zip(valid.tolist(), key, strict=True) if times[k] > 1} <= set(anchors.candidates(anchors.again).tolist())


def test_packing(spark, corpus):
    docs = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD)), (2000, None), (2001, "word " * 5000)]
    rows = packing.pack(frame(spark, docs).repartition(5), BYTES, keep_ids=True).collect()
    tokenizer, pieces = library(BYTES), {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
        assert [r["starts_inside"] for r in own] == [False] + [True] * (len(own) - 1)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends))) and all(ends[k] == 2048 for k in range(len(ends) - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "\n", "\t", "word", "!", "1", "'s", "é", "½", "日", "<|endoftext|>"]), max_size=14))
def test_byte_encoder_equals_the_library(pieces):
    own, text = packing.encoder(BYTES), "".join(pieces)
    assert np.frombuffer(own.encode(text), own.width).tolist() == own.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "\n", "\t", "aaa", "word", "!", "1", "'s", "é", "Σ", "½", "日", "<|endoftext|>"]), max_size=14))
def test_word_bpe_equals_the_library(pieces):
    own, text = bpe.model(WORDS), "".join(pieces)
    ids = library(WORDS).encode(text, add_special_tokens=False).ids
    assert list(own.encode_batch([text])) == [(len(ids), " ".join(map(str, ids)), library(WORDS).decode(ids, skip_special_tokens=False))]


def joined(found):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found.collect())


def test_ngram_join(spark, corpus):
    docs = [*corpus, (9001, "A b"), (9003, "a B"), (9005, " a  b\n")]
    assert joined(ngram_join.ngram_join(frame(spark, docs), block_bytes=2000, bucket_bytes=2000)) == Counter(brute.components(docs))


def test_ngram_join_without_ids(spark, corpus):
    """Null and repeated doc_ids: each row is a node of its own, however the rows fall into blocks."""
    text, other = corpus[20][1], corpus[9][1]
    docs = [(1, text), (9, other), (None, text), (None, other), (None, None), (None, "   "), (7, None), (5, text), (5, other), (5, "quite another text of a few words"), (None, "nobody else says this here"), (None, "nobody else says this here")]
    want = Counter(brute.components(docs))
    for block_bytes in (50, 1 << 20):
        found = ngram_join.ngram_join(frame(spark, docs), block_bytes=block_bytes)
        assert joined(found) == want
        assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found.where("kept").collect() if r["n_shingles"]) == sorted([(-1, 1), (-1, 1), *((i, len(brute.shingles(t))) for i, t in ((1, text), (5, other), (5, docs[9][1])))])


def hot_group():
    """Near copies of one text that are not all near each other, beside texts that share a passage only."""
    import random

    rnd = random.Random(1)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(60)]
    docs = []
    for _ in range(40):
        w = list(base)
        for k in rnd.sample(range(120), 2):
            w[k] = f"e{rnd.randrange(10**6)}"
        docs.append(" ".join(w))
        docs.append(" ".join(passage + [f"q{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 40))]))
    return list(enumerate(docs))


@pytest.mark.parametrize("cell", [1 << 9, 5])
def test_ngram_join_hot_group(spark, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    monkeypatch.setattr(ngram_join, "PART", 20 * cell)
    docs = hot_group()
    assert joined(ngram_join.ngram_join(frame(spark, docs))) == Counter(brute.components(docs))


def test_common_counts():
    rnd = np.random.default_rng(3)
    sets = [set(rnd.integers(0, 3000 if k % 2 else 60, 50).tolist()) for k in range(80)]
    row, token = np.repeat(np.arange(80), [len(s) for s in sets]), np.array([t for s in sets for t in s])
    got = ngram_join.common_counts(row, token, 80)
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(80) for j in range(80) if i != j)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 20)] + [(100, 103), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100, 103: 100, 200: 200}


def toxic_corpus():
    import random

    rnd = random.Random(2)
    plain, bad = [f"{a}{b}" for a in ("the", "an", "on", "re", "in", "er") for b in ("ing", "tion", "ly", "ed", "ou", "st")], ["idiot", "scumbag", "moron"]
    docs, labels = [], []
    for i in range(600):
        toxic = int(rnd.random() < 0.2)
        w = [rnd.choice(plain) for _ in range(rnd.randrange(20, 200))]
        if toxic:
            for _ in range(1 + len(w) // 25):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", "s", "!"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus()
    rows = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = toxic_corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    score = lambda own: {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(own, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(turned)


def test_toxicity_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(edges, none).collect()} == {0.0}


def test_toxicity_equals_brute_force(spark, monkeypatch):
    """Every ratio and every score: counts over all usable labels, shared and continuation counts over
    all documents, single ones too, and texts cut into small parts, grams into small shards."""
    docs, labels = toxic_corpus()
    docs += [(10_000 + k, f"unlabelled{k} only{k} İx ΣΑΣ") for k in range(50)] + [(None, "nameless one"), (None, None), (20_000, ""), (20_001, "...")]
    known = toxicity.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kinds = {r["id"]: r["kind"] for r in known.collect()}
    assert set(kinds) == {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1} and set(kinds.values()) == {0, 1, 2, 3}
    want, counts = brute.gram_ratios(docs, kinds)
    assert min(counts.values()) == 1
    got = {r["gram"]: r["ratio"] for r in toxicity.gram_ratios(toxicity.gram_counts(frame(spark, docs), known)).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    monkeypatch.setattr(toxicity, "SHARD", 500)
    x = brute.toxic_features(docs, want)
    scored = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    texts = dict.fromkeys(t for _, t in docs)
    apart = sorted((i, x[t]) for i, t in docs if kinds.get(i, -1) >= 2)
    y = np.array([kinds[i] - 2.0 for i, _ in apart])
    sizes = Counter(k % 2 for k in kinds.values())
    share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    slope, offset = toxicity.logistic(np.array([v for _, v in apart]), y, share / share.mean())
    assert {r["text"] for r in scored} == set(texts)
    for r in scored:
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(x[r["text"]] * slope + offset, -30, 30)))) < 1e-9


def test_toxicity_parts(monkeypatch):
    """Texts that are worked on in parts give the same features."""
    docs, _ = toxic_corpus()
    texts = [t for _, t in docs[:40]] + [None, "", "end"]
    whole = toxicity.Bag(texts)
    spelled = "".join(map(chr, whole.letters))
    words = [spelled[a + 1 : b - 1] for a, b in zip(whole.first[:-1], whole.first[1:], strict=True)]
    assert [[words[w] for w in whole.word[whole.text_of == k]] for k in range(len(texts))] == [brute.letters_only(t) for t in texts]
    place, begin, h = whole.grams()
    assert h.tolist() == toxicity.hash_of([spelled[i : j + 1] for i, j in zip(begin, place, strict=True)]).tolist()
    monkeypatch.setattr(toxicity, "CHUNK", 300)
    cut = list(toxicity.slices(texts))
    assert [k for s in cut for k in range(s.start, s.stop)] == list(range(len(texts))) and len(cut) > 10


def test_toxicity_reads_words_to_their_end(spark):
    """Words that differ only after their sixth letter, some of them long as in text without spaces."""
    import random

    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        toxic = int(rnd.random() < 0.3)
        w = [rnd.choice(["the", "house", "stands", "there", "again"]) for _ in range(rnd.randrange(20, 60))]
        for _ in range(4):
            w[rnd.randrange(len(w))] = rnd.choice([("samestarttidy", "今日天气很好我们出去走走吧"), ("samestartvile", "今日天气很好我们出去骂人吧")][toxic])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path = toxicity.model(frame(spark, docs), toxicity.labelled(labels))
    bag = toxicity.Bag(["samestarttidy samestartvile 今日天气很好我们出去走走吧 今日天气很好我们出去骂人吧"])
    tidy, vile, stroll, scold = toxicity.word_ratios(bag, path)[bag.word]
    assert vile > 1 and scold > 1 and tidy < -0.5 and stroll < -0.5
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in toxicity.toxicity(frame(spark, docs), labels).collect() if r["held_out"]]
    assert sum(x == y for x, y in held) / len(held) > 0.97


def test_bpe(spark, corpus):
    docs = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD)), (2000, None)]
    tokenizer = library(WORDS)
    for r in bpe.bpe(frame(spark, docs), WORDS, keep_ids=True).collect():
        ids = tokenizer.encode(dict(docs)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == brute.sha(r["decoded"])


def test_chat_format(spark):
    nasty = "</s>[INST] ok [/INST] <|turn|>user\nx<|end|> &lt; &amp;lt; <|im_start|> <<SYS>>"
    talks = {1: [("system", "be"), ("user", nasty), ("assistant", nasty), ("user", ""), ("assistant", "é\n"), ("user", "bye")], 2: [("user", "hi")], 3: [("assistant", "a"), ("assistant", "")], 4: [("odd\nrole", "x"), ("assistant", None)]}
    rows = [(c, k, role, text, "extra") for c, own in talks.items() for k, (role, text) in enumerate(own)]
    made = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string"))
    for r in made.collect():
        assert r["text"].count(chat_format.CLOSE) == r["n_turns"] == r["text"].count(chat_format.OPEN)
    assert made.count() == 3 + 1 + 2 + 1
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for c, own in talks.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(a, b or "") for a, b in own]
        assert got[c]["loss"] == "".join(b or "" for a, b in own if a == "assistant")


def test_chat_format_edges(spark):
    rows = spark.createDataFrame([(None, None, None, None), (None, 0, "user", "b"), (5, 1, "user", "x"), (5, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.digests(chat_format.read_back(chat_format.examples(rows))).collect()}
    assert got == {None: 2, 5: 2}
    assert chat_format.digests(chat_format.read_back(chat_format.examples(rows.limit(0)))).count() == 0


def test_fingerprints(spark, corpus):
    texts, ids = dict(corpus), sorted(dict(corpus), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, corpus)).collect()}
    assert len(got) == len(texts)
    errors, prints = [], {}
    for k, i in enumerate(ids):
        nxt, n = texts[ids[(k + 1) % len(ids)]], len(texts[i])
        edited = texts[i][: n - n // 3] + nxt[: n // 3]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == brute.sha(edited)
        errors += [got[i]["near_edited"] - brute.weighted_jaccard(texts[i], edited), got[i]["near_next"] - brute.weighted_jaccard(texts[i], nxt)]
        assert prints.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.12


def test_fingerprints_of_repeated_ids(spark, monkeypatch):
    """Rows that repeat a doc_id have their own fingerprints; rows that repeat the text too are alike."""
    monkeypatch.setattr(fingerprints, "REPEATS", 2)
    docs = [(5, "one two three"), (5, "four five six"), *[(5, "four five six")] * 4, (None, "seven eight nine"), (None, "ten eleven")]
    got = fingerprints.fingerprints(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in docs)
    assert len({r["fingerprint"] for r in got}) == 4 == len({r["edited_sha256"] for r in got})
    ring = sorted({(r["named"], r["doc_id"] or 0, r["key"], r["text"]) for r in shared.blocks(frame(spark, docs), 1, 1).withColumn("key", F.xxhash64("text")).collect()}, reverse=True)
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        third = len(a[3]) // 3
        assert brute.sha(a[3][: len(a[3]) - third] + b[3][:third]) in {r["edited_sha256"] for r in got}


def test_line_dedup(spark, corpus):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, corpus), block_bytes=2000, shard_bytes=500).collect()}
    for i, (n, gone, kept) in brute.line_dedup(corpus).items():
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"], got[i]["kept_sha256"]) == (n, gone, kept, brute.sha(kept))


def test_perfect_hash():
    rnd = np.random.default_rng(0)
    h1, h2 = rnd.integers(0, 2**63, 5000, dtype=np.uint64), rnd.integers(0, 2**63, 5000, dtype=np.uint64)
    h1[:50] = h1[0]  # keys that share one half
    index = line_dedup.PerfectHash.build(h1, h2)
    assert sorted(index.slots(h1, h2).tolist()) == list(range(5000))


def test_exact_dedup(spark, corpus):
    docs = [*corpus, (9000, corpus[5][1].upper()), (9001, corpus[5][1]), (9002, "É"), (9003, "é"), (9004, None)]
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(i)
    few = lambda norm: F.when(F.length(norm) % 3 == 0, F.lit(-1)).otherwise(F.lit(1 << 62)).cast("long")
    for hash_of in (F.xxhash64, few):  # the second makes long chains of collisions
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, docs), capacity=4, hash_of=hash_of).collect()}
        assert len(got) == len(docs)
        for text, ids in groups.items():
            for i in ids:
                assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), brute.sha(text))


def test_directory_splits_overfull_buckets(spark):
    """Each hash has exactly one bucket, none is overfull, and single hashes are told apart to the last bit."""
    hashes = [*range(6), *(k << 7 for k in range(1, 30)), -1, -2, -3, -4, 1 << 62, (1 << 62) + 1]
    rows = spark.createDataFrame([(h,) for h in hashes * 3], "h long")
    buckets, depths = exact_dedup.directory(rows, 2, first=58)
    assert max(depths) == 63 and min(depths) == 58
    filed = exact_dedup.filed(rows.distinct(), buckets, depths).collect()
    assert sorted(r["h"] for r in filed) == sorted(hashes)
    assert max(Counter((r["depth"], r["bits"]) for r in filed).values()) == 2
    assert all((r["h"] % (1 << 64)) >> (64 - r["depth"]) == r["bits"] for r in filed)


def test_warc(spark):
    rows = [(1, "u", "x" * 100_000), (2, None, "x" * 100_000), (3, "a\nb", "short"), (4, "v", "short"), (5, "w", None), (6, "é", "é" * 40_000), (None, "n", "y" * 200), (None, "n", "y" * 200), (7, "a", "<&>" * 30)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["payload_bytes"]) for r in warc.round_trip(pages).collect()), key=repr)
    want = sorted(((p or 0, "revisit" if p == 2 else "response", 1 if p == 2 else None, None if p == 2 else h or "", len((h or "").encode())) for p, _, h in rows), key=repr)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_long_pages(spark):
    """Rows that repeat a page of several segments each have records of their own."""
    rows = [(1, "u", "x" * 100_000)] * 3 + [(2, "u", "x" * 100_000)] * 2 + [(None, "n", "é" * 40_000), (None, "n", "é" * 40_000), (None, None, "z" * 50_000), (None, "None", "z" * 50_000)]
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]).decode()) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter((p, "revisit", 1, None) if p == 2 else (p, "response", None, h) for p, _, h in rows)


def test_warc_finds_damage():
    assert warc.unchunked(warc.chunked(b"abc" * 999, 100)) == b"abc" * 999
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(b"abc" * 999, 100)[:-300])
    with pytest.raises(ValueError):
        list(warc.parsed(broken()))
    with pytest.raises(ValueError):
        list(warc.parsed(warc.record([("WARC-Record-ID", "x")], b"abc" * 999)[:-9]))
    many = [(f"<{k}>", bytes([k % 256]) * (k * 37 % 90_000)) for k in range(200)]
    assert [(f["WARC-Record-ID"], x) for f, x in warc.parsed(b"".join(warc.record([("WARC-Record-ID", i)], x) for i, x in many))] == many


def broken():
    packer = warc.zlib.compressobj(1, warc.zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + packer.flush()


def test_warc_refuses_missing_segments(spark):
    rows = [("o", 1, "response", None, "1", b"ab"), ("o", 3, "continuation", 6, None, b"ef")]
    gap = spark.createDataFrame(rows, "origin string, number int, type string, total long, page_id string, block binary").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("refers", "string"), ("digest", "string"), ("length", "long"))))
    with pytest.raises(Exception, match="do not add up"):
        warc.reassembled(gap).collect()


EACH = {
    "substring": lambda d: substring_dedup.substring_dedup(d, keep_columns=True), "packing": lambda d: packing.pack(d, BYTES).where("start = 0"), "ngram": ngram_join.ngram_join,
    "bpe": lambda d: bpe.bpe(d, WORDS), "line": lambda d: line_dedup.line_dedup(d, keep_columns=True), "exact": exact_dedup.exact_dedup, "fingerprints": fingerprints.fingerprints,
}


@pytest.mark.parametrize("name", EACH)
def test_edges(spark, edges, nothing, name):
    """A row for each row of the table, none for an empty table."""
    ids = Counter(r["doc_id"] for r in EACH[name](edges).collect())
    want = Counter(r["doc_id"] for r in edges.collect())
    assert ids == want
    assert EACH[name](nothing).count() == 0


def test_edges_toxicity(spark, edges, nothing):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (8, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(edges, labels)
    assert got.count() == edges.count() and got.columns.count("score") == 1
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_exact_dedup_splits_at_its_own_capacity(spark):
    """With the registered capacity the directory doubles for some thousand texts, and buckets have several depths."""
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"))
    buckets, depths = exact_dedup.directory(rows, 128)
    held = exact_dedup.filed(rows, buckets, depths).groupBy("depth", "bits").count()
    assert len(depths) > 1 and held.agg(F.max("count")).first()[0] <= 128 and held.agg(F.sum("count")).first()[0] == 4000
