"""N-gram Jaccard self-join by multiple-global-order filtering.

A document is its set of distinct word n-grams. Under any order of all n-grams, two sets with a
Jaccard similarity of t or more share one of the first n - ceil(t n) + 1 n-grams of each. Three
different orders are used, all rarest first: by frequency, and by coarser frequencies with ties
broken by two other hashes. A pair must share a prefix n-gram under every one of them before its sets
are compared.

Documents with equal sets form a class, and one of them goes on for all. Blocks of documents send
their n-grams to buckets, which count them over the corpus and answer by position, so no n-gram is a
row of its own; n-grams of one class alone are never posted. Large groups are not expanded to
pairs: within each posting list all classes meet its smallest one first, and only classes that the
links so found leave in different components are paired further, by bands of size and in salted
parts of a long list. Links are then counted within components: each is cut into cells by size and
by hash, and two cells at a time are compared by array operations, which give every class its
number of links without a row for any pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.shared import blocks, give_back, ordered, rows_table, staged, text_bytes
from textloom.llm.substring_dedup import by_bucket
from textloom.llm.words import Words, chained, mix

DIGEST = "block int, doc_id long, text_key long, n long, d1 long, d2 long"
PIECE = "bucket int, block int, keys binary, counts binary"
ANSWER = "bucket int, block int, found binary"
BACK = "bucket int, block int, found binary, node long, n long, d1 long, d2 long"
SET = "node long, n long, tokens array<long>, first array<long>, place array<int>, second array<long>, third array<long>"
#: A posting list is paired in parts of about so many classes; a cell has about so many n-grams and classes at most.
PART = 4096
CELL_TOKENS, CELL_SETS = 1 << 18, 1 << 9


class Sets:
    """The distinct n-grams of each text: ``token`` sorted within ``text_of``, and sizes ``n``."""

    def __init__(self, texts: pa.ChunkedArray, size: int):
        words = Words(texts, lower=True)
        count = np.diff(words.first)
        at = np.flatnonzero(words.runs(size))
        text_of, token = [words.text_of[at]], [chained(words.hash, size, 0x9E3779B97F4A7C15)[at] if len(at) else np.zeros(0, np.uint64)]
        for k in range(1, size):  # a shorter text is one n-gram
            short = np.flatnonzero(count == k)
            if len(short):
                text_of.append(short)
                token.append(mix(chained(words.hash, k, 0xD1342543DE82EF95)[words.first[short]] + np.uint64(k)))
        text_of, token = np.concatenate(text_of), np.concatenate(token)
        order = np.lexsort((token, text_of))
        text_of, token = text_of[order], token[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (text_of[1:] != text_of[:-1])] if len(token) else np.zeros(0, bool)
        self.text_of, self.token = text_of[new], token[new]
        self.n = np.bincount(self.text_of, minlength=len(count))
        self.first = np.r_[0, np.cumsum(self.n)]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that identify each set."""
        sums = [np.r_[np.uint64(0), np.cumsum(mix(self.token + np.uint64(k)))] for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        return tuple((s[self.first[1:]] - s[self.first[:-1]]).view(np.int64) for s in sums)

    def only(self, texts: np.ndarray) -> None:
        """Keeps the n-grams of the marked texts."""
        stay = texts[self.text_of]
        self.text_of, self.token = self.text_of[stay], self.token[stay]


def prefix(n: Column | np.ndarray, percent: int):
    return n - (n * percent + 99) // 100 + 1


def as_lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each row from values grouped by row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=rows))], pa.int32()), pa.array(values, kind))


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return (token & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets


def planes(x: np.ndarray) -> bytes:
    """32-bit values as four planes of bytes, of which the high ones are mostly zeros and compress well."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def candidate_sets(docs: DataFrame, size: int, percent: int, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of all documents' digests, of the classes, and of the sets that have shared n-grams in their
    prefixes under all three orders."""
    n_bytes = text_bytes(docs)
    buckets = max(16, math.ceil(n_bytes / bucket_bytes))
    texts = blocks(docs, n_bytes, block_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            sizes = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(sizes // block_bytes)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    sets = Sets(part.column("text"), size)
                    d1, d2 = sets.digests()
                    yield pa.RecordBatch.from_arrays([part.column("block"), part.column("doc_id"), part.column("text_key"), pa.array(sets.n, pa.int64()), pa.array(d1), pa.array(d2)], names=[x.split()[0] for x in DIGEST.split(", ")])

    def chosen(table: pa.Table, reps: dict[tuple, int]) -> tuple[Sets, np.ndarray]:
        """The sets of the block's class representatives, and for each of its texts the class it stands for."""
        sets, wanted = Sets(table.column("text"), size), dict(reps)
        node, mark = np.zeros(len(sets.n), np.int64), np.zeros(len(sets.n), bool)
        for k, key in enumerate(zip(sets.n.tolist(), *(d.tolist() for d in sets.digests()), strict=True)):
            if key in wanted:
                mark[k], node[k] = True, wanted.pop(key)
        sets.only(mark)
        return sets, node

    def reps_of(table: pa.Table) -> dict[tuple, int]:
        return dict(zip(zip(*(table.column(c).to_pylist() for c in ("n", "d1", "d2")), strict=True), table.column("node").to_pylist(), strict=True))

    def ask(table: pa.Table, reps: pa.Table) -> pa.Table:
        if not reps.num_rows:
            return rows_table([], PIECE)
        token, counts = np.unique(chosen(ordered(table), reps_of(reps))[0].token, return_counts=True)
        block, keys = table.column("block")[0].as_py(), (token >> np.uint64(32)).astype("<u4")
        return rows_table([(b, block, planes(np.diff(keys[x], prepend=np.uint32(0))), planes(counts[x])) for b, x in by_bucket(bucket_of(token, buckets))], PIECE)

    def count(table: pa.Table) -> pa.Table:
        give_back()
        keys = [np.cumsum(from_planes(x), dtype=np.uint32) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(x) for x in table.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts)
        rank = np.minimum(255, 16 * np.log2(total)).astype(np.uint8)[which]
        found = [x.tobytes() for x in np.split(rank, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table([table.column("bucket"), table.column("block"), pa.array(found, pa.binary())], names=["bucket", "block", "found"])

    def order(table: pa.Table, back: pa.Table) -> pa.Table:
        told = np.array(back.column("bucket").to_pylist()) >= 0
        reps = reps_of(back.filter(pa.array(~told)))
        table = ordered(table)
        if not reps:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        (sets, node), found = chosen(table, reps), back.filter(pa.array(told))
        token, which = np.unique(sets.token, return_inverse=True)
        rank, answers = np.zeros(len(token), np.uint8), dict(zip(found.column("bucket").to_pylist(), found.column("found").to_pylist(), strict=True))
        for b, x in by_bucket(bucket_of(token, buckets)):
            rank[x] = np.frombuffer(answers[b], np.uint8)
        rank = rank[which]
        first = np.searchsorted(sets.text_of, np.arange(len(sets.n)))
        length, shared, lists = prefix(sets.n, percent), [], []
        for level, tie in ((rank, sets.token), (rank // 16, mix(sets.token)), (rank // 48, mix(sets.token + np.uint64(0xA4093822299F31D0)))):
            at = np.lexsort((tie, level, sets.text_of))
            place = np.arange(len(at)) - first[sets.text_of]  # sorting keeps each text's rows where they are
            keep = (place < length[sets.text_of]) & (rank[at] > 0)
            lists.append((at[keep], place[keep]))
            shared.append(np.bincount(sets.text_of[at[keep]], minlength=len(sets.n)) > 0)
        rows = np.flatnonzero(shared[0] & shared[1] & shared[2])
        row_of = np.full(len(sets.n), -1)
        row_of[rows] = np.arange(len(rows))

        def listed(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
            row = row_of[sets.text_of[at]]
            return as_lists(values[row >= 0], row[row >= 0], len(rows), kind)

        signed, often = sets.token.view(np.int64), np.flatnonzero(rank > 0)
        (a, place), (b, _), (c, _) = lists
        return pa.table([pa.array(node[rows]), pa.array(sets.n[rows]), listed(often, signed[often], pa.int64()), listed(a, signed[a], pa.int64()), listed(a, place, pa.int32()), listed(b, signed[b], pa.int64()), listed(c, signed[c], pa.int64())], names=names)

    names = [x.split()[0] for x in SET.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    digests = staged(texts.select("block", "doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(digest, DIGEST), "digests")
    same = digests.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("block").alias("block"), F.count(F.lit(1)).alias("members"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least"))
    # Nodes are numbered in the order of the classes' least rows.
    classes = staged(same.orderBy("least").select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    reps = classes.select("block", "node", "n", "d1", "d2")
    pieces = texts.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(ask, PIECE)
    answers = pieces.groupBy("bucket").applyInArrow(count, ANSWER)
    back = answers.unionByName(reps.withColumn("bucket", F.lit(-1)), allowMissingColumns=True).select(*(x.split()[0] for x in BACK.split(", ")))
    sets = staged(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(order, SET), "sets")
    return digests, classes, sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) that pass the second and third order's filter, those that link, as (a, b)."""
    side = lambda k: sets.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("n", "tokens", "second", "third")))
    both = pairs.join(side("y"), "y").join(side("x"), "x")
    near = both.where("100 * least(x_n, y_n) >= %d * greatest(x_n, y_n)" % percent).where(F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third"))
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return near.where(100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def band(n: Column, percent: int) -> Column:
    """Sets whose sizes are near enough to link are in the same band or in neighbouring ones."""
    return F.floor(F.ln(n) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else n.cast("int")


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component): the smallest node reachable from each one that has a link."""
    postings = sets.select("node", "n", F.explode(F.arrays_zip("first", "place")).alias("p")).select("node", "n", F.col("p.first").alias("token"), F.col("p.place").alias("place"))
    hubs = staged(postings.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1"), "hubs")
    star = postings.join(hubs, "token").where("node <> hub").select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()
    labels = components(staged(verified(star, sets, percent), "links")).select(F.col("node").alias("of"), "label")

    # What the first links leave apart: in each list, rows outside the component of its smallest class.
    named = postings.join(labels, postings["node"] == labels["of"], "left").select("token", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    hub_labels = hubs.join(labels, hubs["hub"] == labels["of"], "left").select("token", "hub", F.coalesce("label", "hub").alias("hub_label"), F.ceil(F.col("held") / PART).cast("long").alias("parts"))
    listed = staged(named.join(staged(hub_labels, "hub-labels"), "token").where("node <> hub").withColumn("band", band(F.col("n"), percent)), "listed")
    outside = listed.where("label <> hub_label").select("token", "band", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("place").alias("x_place"), F.col("label").alias("x_label"), F.pmod(F.xxhash64("node"), "parts").alias("part"))
    outside = outside.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    rest = listed.select("token", "band", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("place").alias("y_place"), F.col("label").alias("y_label"), "hub_label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = (F.col("x_n") + F.col("y_n")) * percent
    left_over = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))  # no more n-grams can be shared from here on
    apart = (F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("hub_label")) | (F.col("x") < F.col("y")))
    fits = (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (left_over * (100 + percent) >= both)
    more = outside.join(rest, ["token", "band", "part"]).where(apart & fits).select("x", "y").distinct()
    further = staged(verified(more, sets, percent), "links")
    lifted = further.join(labels.select(F.col("of").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("of").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    single = further.select(F.explode(F.array("a", "b")).alias("of")).distinct().join(labels, "of", "left_anti")
    final = labels.unionByName(single.select("of", F.col("of").alias("label")))
    return staged(final.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select(F.col("of").alias("node"), F.coalesce("least", "label").alias("component")), "components")


def common_counts(row: np.ndarray, token: np.ndarray, rows: int, few: int = 32) -> np.ndarray:
    """A matrix of how many tokens each two rows share; ``row`` and ``token`` are their memberships."""
    _, which, times = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    rare = times[which] <= few
    r, w = row[rare], which[rare]
    out = np.zeros(rows * rows, np.float32)
    for step in range(1, few):  # tokens of few rows: each two of their rows
        same = np.flatnonzero(w[step:] == w[:-step])
        if not len(same):
            break
        out += np.bincount(r[same] * rows + r[same + step], minlength=rows * rows)
    out = out.reshape(rows, rows)
    out += out.T
    r, w = row[~rare], np.unique(which[~rare], return_inverse=True)[1]
    for a in range(0, int(w.max(initial=-1)) + 1, few * 64):  # others: products of membership matrices
        here = (w >= a) & (w < a + few * 64)
        held = np.zeros((rows, few * 64), np.float32)
        held[r[here], w[here] - a] = 1
        out += held @ held.T
    return out


def link_counts(sets: DataFrame, best: DataFrame, classes: DataFrame, percent: int, bucket_bytes: int) -> DataFrame:
    """(node, links): how many documents of other classes each class links with; links lie within components."""
    sized = sets.select("node", "n", F.size("tokens").cast("long").alias("t"), band(F.col("n"), percent).alias("band"))
    plain = staged(sized.join(best, "node").join(classes.select("node", "members"), "node"), "members")
    one = plain.groupBy("component").agg(((F.sum("t") <= CELL_TOKENS) & (F.count(F.lit(1)) <= CELL_SETS)).alias("one"))
    banded = plain.join(one, "component").withColumn("band", F.when(F.col("one"), F.lit(0)).otherwise(F.col("band")))
    cells = F.greatest(F.ceil(F.sum("t") / CELL_TOKENS), F.ceil(F.count(F.lit(1)) / CELL_SETS), F.lit(1)).cast("int")
    sums = staged(banded.groupBy("component", "band").agg(cells.alias("cells")), "cells")
    beside = sums.select("component", (F.col("band") - 1).alias("band"), F.col("cells").alias("above")), sums.select("component", (F.col("band") + 1).alias("band"), F.col("cells").alias("below"))
    known = sums.join(beside[0], ["component", "band"], "left").join(beside[1], ["component", "band"], "left")
    placed = banded.join(known, ["component", "band"]).withColumn("cell", F.pmod(F.xxhash64("node"), "cells").cast("int"))
    # Each class goes to the tasks of its cell with every cell of its own band and of the neighbouring ones.
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    task = lambda lo, a, hi, b: F.struct(lo.alias("lo"), a.alias("a"), hi.alias("hi"), b.alias("b"))
    here, cell, none = F.col("band"), F.col("cell"), F.array().cast("array<struct<lo:int,a:int,hi:int,b:int>>")
    own = F.transform(upto("cells"), lambda k: task(here, F.least(cell, k), here, F.greatest(cell, k)))
    above = F.when(F.col("above").isNotNull(), F.transform(upto("above"), lambda k: task(here, cell, here + 1, k))).otherwise(none)
    below = F.when(F.col("below").isNotNull(), F.transform(upto("below"), lambda k: task(here - 1, k, here, cell))).otherwise(none)
    tasks = placed.withColumn("task", F.explode(F.concat(own, above, below)))
    n = max(32, math.ceil(tasks.agg(F.coalesce(F.sum(8 * F.col("t")), F.lit(0))).first()[0] / bucket_bytes))
    key = F.xxhash64("component", "task")
    alone, second = (F.col("task.lo") == F.col("task.hi")) & (F.col("task.a") == F.col("task.b")), (here == F.col("task.hi")) & (cell == F.col("task.b"))
    tasks = tasks.select(F.pmod(key, F.lit(n)).cast("int").alias("bucket"), key.alias("key"), "node", "n", "members", alone.alias("alone"), second.alias("second"))
    sent = tasks.join(sets.select("node", "tokens"), "node")

    def count(table: pa.Table) -> pa.Table:
        give_back()
        table = table.sort_by([("key", "ascending"), ("node", "ascending")])
        keys, nodes, size, members, alone, second = (table.column(c).to_numpy() for c in ("key", "node", "n", "members", "alone", "second"))
        lists = table.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        links = np.zeros(len(keys), np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if b - a > 1:
                row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                common = common_counts(row, tokens[bounds[a] : bounds[b]], b - a)
                hit = 100 * common >= percent * (size[a:b, None] + size[None, a:b] - common)
                if alone[a]:
                    np.fill_diagonal(hit, False)
                else:
                    hit &= second[a:b, None] != second[None, a:b]
                links[a:b] = hit @ members[a:b]
        return pa.table([pa.array(nodes), pa.array(links)], names=["node", "links"])

    return sent.groupBy("bucket").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_key and kept for every row.

    Words are lower-cased in A-Z only; a text of fewer than ``size`` words is one n-gram, one without words
    has the empty set and no links. Two rows link when 100 * intersection >= ``percent`` *
    union; n_links counts the rows that a row links with, and component_id is the smallest doc_id
    reachable. Every row is a node of its own, also one without a doc_id or one that repeats one; a
    component without any doc_id has a null component_id. ``kept`` marks one row of each component,
    that with the smallest doc_id and, among those, text_key (a hash of the text); rows that repeat
    both are all marked. Rows without words are all kept. An empty table gives no rows; other columns are ignored.
    """
    digests, classes, sets = candidate_sets(docs, size, percent, block_bytes, bucket_bytes)
    best = linked(sets, percent)
    links = link_counts(sets, best, classes, percent, bucket_bytes)
    known = classes.join(best, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("first"))
    told = staged(known.join(least, "component").select("n", "d1", "d2", "first", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told")
    found = digests.join(told, ["n", "d1", "d2"], "left")
    kept = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    alone = F.col("first").isNull()
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "text_key", kept.alias("kept"))
