"""Toxicity by class-conditional models over a shared Kneser-Ney model.

The models say how words go on: P(next letter | up to ``DEPTH`` letters before it), for every letter to
the end of a word, however long. The shared model is counted on all documents, labelled or not;
its discounted counts back off to continuation counts (in how many distinct places a pair of letters
occurs). A class's likelihood is the shared one times (seen + PRIOR) / (expected + PRIOR), so an
expression that neither class knows well gets nearly equal likelihoods, and a class of few rows is
not surprised by what it had no chance to see. A document's score adds the words' log-likelihood
ratios with their signs, normalised by its number of words. Every word has its part in it, but small differences, which
added over long texts tell the classes' languages rather than their manners, are weighed down without a step: a ratio r counts r^8 / (r^8 + HALF^8)
of itself. Words have no context of other words. A logistic curve fitted on labelled rows kept apart gives the probability.

Two passes read the texts. The first folds the grams of all words of a task together and adds them up
by a shuffle; no gram is left out for being rare. Texts that may be labelled are joined with the labels
before it, all others stay where they are. The ratios are written to the shared folder as shards in
order of a hash. The second pass scores each text where it is: a task looks its own distinct grams up
shard by shard, so it holds a bounded part of the table however large that is.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import give_back, new_path, staged, text_bytes
from textloom.llm.words import hashed, mix

DEPTH = 6
DISCOUNT = 0.9
PRIOR = 5.0
#: The ratio of a word that counts by half.
HALF = 3.0
#: Labelled rows of each class that the logistic curve, with its two parameters, is fitted on.
CURVE_ROWS = 5_000
#: Letters of text that are worked on at once, grams that a task holds before it sends them, grams of a shard.
CHUNK = 2 << 20
HELD = 1 << 19
SHARD = 1 << 19
#: Bytes of text for each bucket that grams are added up in.
BUCKET = 16 << 20
PIECE = "bucket int, sizes binary, letters binary, counts binary"
#: -1: no label to learn from; 0 and 1: counted in a class; 2 and 3: kept apart for the curve.
NO_CLASS = -1
#: Code points that end words: Unicode's white space, ASCII punctuation and digits.
GAPS = np.zeros(0x3002, bool)
GAPS[[i for i in range(0x3002) if chr(i).isspace() or chr(i) in string.punctuation + string.digits]] = True
OPEN, CLOSE = ord("^"), ord("$")
#: A multiplier for each place of a gram, counted from its last letter.
PLACES = mix(np.arange(1, DEPTH + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3: rows with 1 are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


class Bag:
    """The words of some texts: ``distinct`` ones as code points between OPEN and CLOSE, and ``word``,
    the place among them of each word of each text in ``text_of``."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        bounds = np.r_[0, np.cumsum([len(t) + 1 for t in lowered])]
        points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        gap = np.r_[True, GAPS[np.minimum(points, len(GAPS) - 1)]]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edges[::2], edges[1::2]
        _, at, self.word = np.unique(hashed(points.view(np.uint8), 4 * start, 4 * end), return_index=True, return_inverse=True)
        self.text_of = np.searchsorted(bounds, start, "right") - 1
        size = end[at] - start[at] + 2
        self.first = np.r_[0, np.cumsum(size)]
        self.word_of = np.repeat(np.arange(len(at)), size)
        self.letters = points[np.minimum(np.arange(self.first[-1]) - np.repeat(self.first[:-1] - start[at] + 1, size), len(points) - 1)].copy()
        self.letters[self.first[:-1]], self.letters[self.first[1:] - 1] = OPEN, CLOSE
        self.distinct = len(at)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each letter but OPEN: its place, the place where its gram begins, and the gram's hash."""
        place = np.arange(len(self.letters))
        depth = np.minimum(place - self.first[self.word_of], DEPTH)
        keep = depth > 0
        place, depth = place[keep], depth[keep]
        return place, place - depth, gram_hash(self.letters, place, depth)


def gram_hash(letters: np.ndarray, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A hash of the ``depth`` letters before each place and the letter there."""
    wide, out = letters.astype(np.uint64) + np.uint64(1), depth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(DEPTH + 1):
        out += np.where(depth >= k, wide[np.maximum(place - k, 0)], np.uint64(0)) * PLACES[k]
    return mix(out)


def hash_of(grams: list[str]) -> np.ndarray:
    """The same hash of grams as texts."""
    size = np.array([len(g) for g in grams], np.int64)
    letters = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
    return gram_hash(letters, np.cumsum(size) - 1, size - 1)


def slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about CHUNK letters; a longer text is a run of its own."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK:
            yield slice(first, k)
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield slice(first, len(texts))


def labelled(labels: DataFrame) -> DataFrame:
    """(id, kind) of every doc_id whose label may be learned from; ``kind`` as at NO_CLASS.

    Of each class CURVE_ROWS doc_ids at most, in an order by hash and out of a quarter, are kept apart.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("id")) != 1)
    single = usable.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("id"))
    quarter = single.where(F.pmod("h", F.lit(4)) == 0)
    apart = [quarter.where(F.col("toxic") == k).orderBy("h").limit(CURVE_ROWS).select("id", F.lit(True).alias("apart")) for k in (0, 1)]
    return staged(single.join(F.broadcast(apart[0].unionByName(apart[1])), "id", "left").select("id", (F.col("toxic") + F.when(F.col("apart"), 2).otherwise(0)).alias("kind")), "labelled")


def gram_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(gram, a, b, t): over the distinct words of each document, how often the gram is in those of
    the ordinary class, of the toxic one, and of all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    may = F.coalesce(fold(F.col("id")) != 1, F.lit(False))  # only such rows can have a label that is learned from
    none = F.lit(NO_CLASS).alias("kind")
    joined = rows.where(may).join(known.hint("merge"), "id", "left").select(F.coalesce("kind", F.lit(NO_CLASS)).alias("kind"), "text")
    return gathered(rows.where(~may).select(none, "text").unionByName(joined), max(16, -(-text_bytes(docs) // BUCKET)))


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """Gram counts of (kind, text). A task sends a bucket's grams as one row: their letters on end, and byte
    planes of their counts, most of which are zeros and vanish when the shuffle compresses them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grams, sums = np.zeros(0, np.uint64), np.zeros(0, object), np.zeros((0, 3), np.int64)
        for batch in batches:
            give_back()
            texts, kinds = batch.column("text").to_pylist(), batch.column("kind").to_numpy()
            for part in slices(texts):
                bag = Bag(texts[part])
                if not bag.distinct:
                    continue
                pairs = np.unique(bag.text_of * bag.distinct + bag.word)
                word, kind = pairs % bag.distinct, kinds[part][pairs // bag.distinct]
                counts = [np.bincount(word[at], minlength=bag.distinct) for at in (kind == 0, kind == 1, slice(None))]
                place, begin, own = bag.grams()
                own, at, which = np.unique(own, return_index=True, return_inverse=True)
                added = np.stack([np.bincount(which, c[bag.word_of[place]], len(own)).astype(np.int64) for c in counts], 1)
                spelled = bag.letters.tobytes().decode("utf-32-le", "surrogatepass")
                new = np.empty(len(own), object)
                new[:] = [spelled[i : j + 1] for i, j in zip(begin[at].tolist(), place[at].tolist(), strict=True)]
                key, first, which = np.unique(np.r_[key, own], return_index=True, return_inverse=True)
                grams, both = np.r_[grams, new][first], np.r_[sums, added]
                sums = np.stack([np.bincount(which, both[:, k], len(key)).astype(np.int64) for k in range(3)], 1)
                if len(key) >= HELD:
                    yield as_batch(key, grams, sums)
                    key, grams, sums = key[:0], grams[:0], sums[:0]
        if len(key):
            yield as_batch(key, grams, sums)
        key = grams = sums = None
        give_back()

    def as_batch(key: np.ndarray, grams: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            raw = [g.encode("utf-8", "surrogatepass") for g in grams[at]]
            planes = np.ascontiguousarray(sums[at].T, "<u4").view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)
            rows.append((int(bucket[at[0]]), bytes(map(len, raw)), b"".join(raw), planes.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "sizes", "letters", "counts"])

    def add(table: pa.Table) -> pa.Table:
        parts = []
        for sizes, letters, counts in zip(*(table.column(c).to_pylist() for c in ("sizes", "letters", "counts")), strict=True):
            ends = np.r_[0, np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int32)].astype(np.int32)
            grams = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters))
            planes = np.frombuffer(counts, np.uint8).reshape(3, 4, -1).transpose(0, 2, 1)
            parts.append(pa.table([grams, *(pa.array(np.ascontiguousarray(x).view("<u4")[:, 0].astype(np.int64)) for x in planes)], names=["gram", "a", "b", "t"]))
        sums = pa.concat_tables(parts).group_by("gram").aggregate([(c, "sum") for c in "abt"])
        return sums.select(["gram", "a_sum", "b_sum", "t_sum"]).rename_columns(["gram", "a", "b", "t"])

    return staged(rows.mapInArrow(run, PIECE).groupBy("bucket").applyInArrow(add, "gram string, a long, b long, t long"), "grams")


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): the log-likelihood ratio, toxic to ordinary, of a gram's last letter after the letters before it."""
    parts = grams.select("*", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.expr("substring(gram, -2, 1)").alias("y"), F.expr("substring(gram, -1, 1)").alias("x"))
    letters = parts.select(F.countDistinct("x")).first()[0] or 1
    places = parts.groupBy("y", "x").agg(F.count(F.lit(1)).alias("places"))
    after = Window.partitionBy("y")
    d, more = F.lit(DISCOUNT), lambda n: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))
    base = places.select("y", "x", ((more("places") + d * F.count(F.lit(1)).over(after) / letters) / F.sum("places").over(after)).alias("base"))
    here = Window.partitionBy("context")
    summed = parts.select("*", *(F.sum(c).over(here).alias(f"{c}_total") for c in "abt"), F.count(F.lit(1)).over(here).alias("t_kinds"))
    shared = summed.join(base, ["y", "x"]).withColumn("shared", (more("t") + d * F.col("t_kinds") * F.col("base")) / F.col("t_total"))
    # A class's likelihood is the shared one times seen to expected; PRIOR stands for what was not seen for want of rows.
    p = [F.col("shared") * (F.col(c) + PRIOR) / (F.col(f"{c}_total") * F.col("shared") + PRIOR) for c in "ab"]
    return shared.select("gram", F.ln(p[1] / p[0]).alias("ratio"))


def model(docs: DataFrame, known: DataFrame) -> str:
    """Writes the ratios to the shared folder, as shards in order of the grams' hashes, and returns its path.

    Grams after letters that no labelled row has are left out: their ratio is exactly 0, as is that of
    a gram which is not found.
    """
    grams = gram_counts(docs, known)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(hash_of(batch.column("gram").to_pylist()).view(np.int64)), batch.column("ratio")], names=["h", "ratio"])

    ratios = gram_ratios(grams).where("ratio <> 0").mapInArrow(hashed, "h long, ratio double")
    path = new_path(docs.sparkSession, "ratios")
    ratios.repartitionByRange(max(1, -(-grams.count() // SHARD)), "h").sortWithinPartitions("h").write.parquet(path)
    return path


@functools.lru_cache(8)
def shards(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, base = fs.FileSystem.from_uri(path)
    return store, sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))


@functools.lru_cache(4)
def shard(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    store, files = shards(path)
    table = pq.read_table(files[k], filesystem=store, partitioning=None)
    return table.column("h").to_numpy(), table.column("ratio").to_numpy()


def looked_up(h: np.ndarray, path: str) -> np.ndarray:
    """The ratio of each of the sorted hashes; one shard after the other, four at most are kept in a worker."""
    out = np.zeros(len(h))
    for k in range(len(shards(path)[1])):
        keys, ratios = shard(path, k)
        if len(keys):
            a, b = np.searchsorted(h, keys[0]), np.searchsorted(h, keys[-1], "right")
            at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
            out[a:b] = np.where(keys[at] == h[a:b], ratios[at], 0.0)
    return out


def word_ratios(bag: Bag, path: str) -> np.ndarray:
    """The weighed ratio of each distinct word."""
    place, _, key = bag.grams()
    own, which = np.unique(key.view(np.int64), return_inverse=True)
    each = np.bincount(bag.word_of[place], looked_up(own, path)[which], bag.distinct)
    return each * (each**8 / (each**8 + HALF**8))


def features(texts: list[str | None], path: str) -> np.ndarray:
    """What the curve sees of each text: its ratio per word, on a scale of logarithms."""
    out = []
    for part in slices(texts):
        bag, n = Bag(texts[part]), part.stop - part.start
        total = np.bincount(bag.text_of, word_ratios(bag, path)[bag.word], n) if bag.distinct else np.zeros(n)
        mean = total / np.maximum(np.bincount(bag.text_of, minlength=n), 1)
        out.append(np.sign(mean) * np.log1p(np.abs(mean) / 0.003))
    return np.concatenate([np.zeros(0), *out])


def feature(text: Column, path: str) -> Column:
    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(features(batch.to_pylist(), path))
            give_back()

    return of(text)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[str, float, float] | None:
    """The path of the ratios and the logistic curve's slope and offset; None where a class has no rows."""
    known = labelled(labels)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy(F.pmod("kind", F.lit(2)).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    path = model(docs, known)
    apart = known.where("kind >= 2").select("id", (F.col("kind") - 2).alias("y"))  # at most 2 * CURVE_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(apart), "id")
    found = rows.select("id", "y", feature(F.col("text"), path).alias("x")).groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    if found["y"].nunique() < 2:
        return None
    y = found["y"].to_numpy(float)
    share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return path, *logistic(found["x"].to_numpy(), y, share / share.mean())


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, by Newton's method with a slight ridge."""
    design, beta = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (share * (y - p)) - 1e-3 * beta
        beta = beta + np.linalg.solve(design.T @ (design * (share * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with held_out, score (0 to 1) and predicted added.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1, from all of them but
    those kept apart for the curve; a doc_id with several labels counts as toxic if one of them says so, and null labels are
    ignored. A score depends on nothing but the text. Null and empty texts score as texts whose words tell
    nothing; without labels of both classes every score is 0. A null doc_id is not held out.
    Repeated rows are scored each for itself; columns named as the added ones are replaced; an
    empty table gives no rows. Texts are scored whole.
    """
    plain = docs.drop("held_out", "score", "predicted")
    fitted = fit(docs, labels)
    if fitted is None:
        score = F.lit(0.0)
    else:
        path, slope, offset = fitted
        score = 1 / (1 + F.exp(-F.least(F.greatest(feature(F.col("text"), path) * slope + offset, F.lit(-30.0)), F.lit(30.0))))
    scored = plain.withColumn("score", score)
    return scored.select(*(F.col(f"`{c}`") for c in plain.columns), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
