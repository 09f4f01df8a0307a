"""Line dedup by a sharded minimal perfect hash.

Documents are dealt to blocks. Each block sends, once for each distinct line key, the key's 128-bit
hash with its count of documents and smallest doc_id to the key's shard; a line that stands in very
many documents thus costs one entry a block. A shard puts its distinct keys into a minimal perfect hash
whose slots index compact arrays of fingerprints, counts and smallest doc_ids. The blocks' keys
probe the arrays of their shard, and the answers return to the blocks by position; lines themselves
are never joined or shuffled, and texts are shuffled once for both passes.
"""

from __future__ import annotations

import hashlib
import math
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import blocks, ordered, rows_table, text_bytes

BLANK = b"\t\n\x0b\x0c\r "
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
NULL_ID = -(1 << 63)


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: bit arrays level by level, each holding the
    keys that are alone at their position; a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - 1)
            before += int(bits.sum())

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            size = max(64, 2 * len(h1))
            at = (mixed(h1, h2, len(levels)) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            levels.append(count == 1)
            rest = count[at] > 1
            h1, h2 = h1[rest], h2[rest]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys outside the set some slot or -1."""
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            at = (mixed(h1[open_], h2[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def keys_of(text: str, least: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, or None where the key is shorter than ``least`` code points."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n"):
        key = line.strip(BLANK)
        # A code point has at most four bytes.
        long_enough = len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def block_keys(docs: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Sorted distinct keys (h1, h2) of a block, documents and smallest doc_id for each, and for each
    document its text and line keys."""
    texts, ids = docs.column("text").to_pylist(), docs.column("doc_id").fill_null(NULL_ID).to_pylist()
    keys = [keys_of(t, least) for t in texts]
    seen: dict[bytes, list] = {}
    for doc_id, own in zip(ids, keys, strict=True):
        for k in dict.fromkeys(own):
            if k is not None:
                if k in seen:
                    seen[k][0] += 1
                    seen[k][1] = min(seen[k][1], doc_id)
                else:
                    seen[k] = [1, doc_id]
    order = sorted(seen)
    halves = np.frombuffer(b"".join(order), "<u8").reshape(-1, 2)
    counts, least_id = np.array([seen[k][0] for k in order], np.int64), np.array([seen[k][1] for k in order], np.int64)
    return halves[:, 0].copy(), halves[:, 1].copy(), counts, least_id, texts, keys


PIECE = "shard int, block int, h1 binary, h2 binary, n binary, least binary"
ANSWER = "shard int, block int, least binary"
NONE = np.iinfo(np.int64).max  # no other holder: every doc_id is at most this


def line_dedup(docs: DataFrame, least_chars: int = 10, keep_columns: bool = False, block_bytes: int = 2 << 20, shard_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped and kept_sha256 for every row; with
    ``keep_columns`` also ``rest``, a struct of the other columns.

    Lines end at \\n. A line's key is the line without blanks at both ends, with A-Z lower-cased.
    Keys of ``least_chars`` code points or more that stand in two or more rows lose their lines
    everywhere but in the row with the smallest doc_id. A null or empty text is one empty line. A
    null doc_id is smaller than any other. Rows that repeat a doc_id are rows of their own: those
    that tie for the smallest doc_id all keep their lines. An empty table gives no rows.
    """
    n_bytes = text_bytes(docs)
    shards = max(16, math.ceil(n_bytes / shard_bytes))
    own = blocks(docs, n_bytes, block_bytes, keep_columns=keep_columns)

    def ask(table: pa.Table) -> pa.Table:
        h1, h2, n, least, _, _ = block_keys(table, least_chars)
        shard = (h1 % np.uint64(shards)).astype(np.int64)
        block, rows = table.column("block")[0].as_py(), []
        for s in np.unique(shard):
            at = shard == s
            rows.append((int(s), block, h1[at].tobytes(), h2[at].tobytes(), n[at].tobytes(), least[at].tobytes()))
        return rows_table(rows, PIECE)

    def answer(table: pa.Table) -> pa.Table:
        asked = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("h1", "<u8"), ("h2", "<u8"), ("n", "<i8"), ("least", "<i8"))]
        h1, h2, n, least = (np.concatenate(x) for x in asked)
        order = np.lexsort((h2, h1))
        h1, h2, n, least = h1[order], h2[order], n[order], least[order]
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        index = PerfectHash.build(h1[first], h2[first])
        place = np.argsort(index.slots(h1[first], h2[first]))
        prints, counts, smallest = h2[first][place], np.add.reduceat(n, first)[place], np.minimum.reduceat(least, first)[place]
        out = []
        for s, block, a, b in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), *asked[:2], strict=True):
            slots = index.slots(a, b)
            if not (prints[slots] == b).all():
                raise ValueError("a key is not at its slot")
            out.append((s, block, np.where(counts[slots] >= 2, smallest[slots], NONE).tobytes()))
        return rows_table(out, ANSWER)

    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        h1, h2, _, _, texts, keys = block_keys(table, least_chars)
        shard, least = (h1 % np.uint64(shards)).astype(np.int64), np.full(len(h1), NONE)
        for s, x in zip(answers.column("shard").to_pylist(), answers.column("least").to_pylist(), strict=True):
            least[shard == s] = np.frombuffer(x, "<i8")
        owner = dict(zip((a + b for a, b in zip(split8(h1), split8(h2), strict=True)), least.tolist(), strict=True))
        kept, n_lines, n_dropped = [], [], []
        for doc_id, text, own_keys in zip(table.column("doc_id").fill_null(NULL_ID).to_pylist(), texts, keys, strict=True):
            goes = [k is not None and owner[k] < doc_id for k in own_keys]
            kept.append("\n".join([x for x, g in zip(text.split("\n"), goes, strict=True) if not g]) if any(goes) else text)
            n_lines.append(len(goes))
            n_dropped.append(sum(goes))
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
        arrays = [table.column("doc_id").combine_chunks(), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"]
        if "rest" in table.column_names:
            arrays, names = [*arrays, table.column("rest")], [*names, "rest"]
        return pa.table(arrays, names=names)

    answers = own.groupBy("block").applyInArrow(ask, PIECE).groupBy("shard").applyInArrow(answer, ANSWER)
    schema = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"
    if "rest" in own.columns:
        schema += f", rest {own.schema['rest'].dataType.simpleString()}"
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(drop, schema)


def split8(x: np.ndarray) -> list[bytes]:
    raw = x.astype("<u8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]
