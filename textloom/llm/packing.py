"""Packing into fixed windows by concatenate-and-cut.

Pass 1 tokenizes every document once, on the partition that reads it, and writes a table of token
ids with each document's offset inside its partition. The prefix sum over the partition totals (one
row per partition) then gives every document its global offset, and pass 2 cuts each document at
the multiples of the window length: no shuffle moves the tokens, and only the last sequence of the
corpus is short. A piece that starts or ends inside its document is a boundary record.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import give_back, staged

#: Characters on whose classes libraries might differ, and blanks that one token may hold together: runs of three or
#: more, or of two at the text's end.
ODD = re.compile(r"[^\t\n\x20-\x7eÀ-ÖØ-öø-ɏ]")
BLANKS = re.compile(r"\s\s\s")
CACHE = 400_000

_ENCODERS: dict[str, "ByteEncoder"] = {}


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by the published rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoded(dict):
    """The ids of words, each with ``before`` in front of it, encoded when they are first asked for."""

    def __init__(self, encoder: ByteEncoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encoder._bytes(self.encoder.fast(self.before + word))
        return ids


class ByteEncoder:
    """Byte-level BPE of a tokenizer file, as little-endian 16-bit ids.

    Words are cached: in plain texts a token never spans a single space or line break, so each word
    with its space is encoded once per task. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.specials = tuple(specials)
        self.width = "<u2" if max([*ranks.values(), *specials.values()]) < 1 << 16 else "<u4"
        self.first, self.later = Encoded(self, ""), Encoded(self, " ")
        self.line_break = self._bytes(self.fast("\n"))

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == "<u2" else "I", ids).tobytes()  # quicker than numpy for a few ids

    def encode(self, text: str) -> bytes:
        if ODD.search(text) or BLANKS.search(text) or text[-2:].isspace() or any(s in text for s in self.specials):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        for cache in (self.first, self.later):
            if len(cache) > CACHE:
                cache.clear()
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_break)
            head, *words = line.split(" ")
            if head:
                out.append(self.first[head])
            out += map(self.later.__getitem__, words)
        return b"".join(out)


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, seq, doc_id, before, n, ids): one row per document; ``before`` counts the ids of the
    earlier documents of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before, seq = encoder(tokenizer), 0, 0
        end, size = enc._bytes([end_id]), np.dtype(enc.width).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = [enc.encode(t or "") + end for t in part.column("text").to_pylist()]
                n = np.array([len(x) // size for x in ids], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), pa.array(np.arange(seq, seq + len(n))), part.column("doc_id"), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "seq", "doc_id", "before", "n", "ids"],
                )
                before, seq = int(ends[-1]), seq + len(n)
        give_back()

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "part int, seq long, doc_id long, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    boundary flags starts_inside and ends_inside (with ``keep_ids`` also the piece's ids).

    A document's ids are those of the tokenizer file followed by ``end_id``. Null and empty texts
    give that one id; null doc_ids are kept as they are; equal rows are packed each for itself; an
    empty table gives no rows; other columns are ignored. Texts of any length are cut at windows.
    """
    tokens = staged(tokenized(docs, tokenizer, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # A row for each partition. Written down, it has a known size, by which Spark broadcasts it or not.
    bases = staged(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")), "bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(encoder(tokenizer).width)
        for batch in batches:
            rows, crcs, pieces = [], [], []
            for k, (at, n, ids) in enumerate(zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                values = np.frombuffer(ids, width).astype("<u4")
                lo = 0
                while lo < n:
                    hi = min(n, lo + window - (at + lo) % window)
                    rows.append((k, lo, hi - lo, (at + lo) // window, (at + lo) % window))
                    piece = values[lo:hi].tobytes()
                    crcs.append(zlib.crc32(piece))
                    if keep_ids:
                        pieces.append(piece)
                    lo = hi
            k, lo, size, sequence, offset = np.array(rows, np.int64).reshape(-1, 5).T
            n = batch.column("n").to_numpy()[k]
            arrays = [batch.column("doc_id").take(pa.array(k)), lo, size, np.array(crcs, np.int64), n, sequence, offset, lo > 0, lo + size < n]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "starts_inside", "ends_inside"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(pieces, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)

    placed = tokens.join(bases, "part").select("doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, starts_inside boolean, ends_inside boolean"
    return placed.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))
