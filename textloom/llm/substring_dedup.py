"""Substring dedup by recompression.

Recompression renames a text round by round: first maximal runs of one word, then, in each further
round, the pairs of neighbours whose left part falls in the left half of the alphabet and whose right part in
the right half (the halves are drawn anew each round by a hash of the name). Names are 64-bit
fingerprints of what they stand for, so all tasks give equal strings equal names without a shared
dictionary. For every symbol we keep the range of words that its name and its bounds depend on; a
window of words that contains that range holds this symbol wherever else it stands. Each window is
thus given its consistent interior symbols of the highest level that has any.

A dictionary of names shared by all tasks would shuffle the whole corpus in every round; fingerprints
need none. That two names agree by chance only makes a window a candidate: repeats are settled on the words.

Two exchanges follow. In the first, blocks of documents send their distinct symbols to buckets,
which answer, by position, which ones occur again in the corpus. Only windows all of whose symbols
do are sent on, once for each block, with a 128-bit BLAKE2b digest of their words and their place; the buckets
verify the repeat on it and answer with the windows that start earlier elsewhere. A passage that
stands in very many documents costs one entry a block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.shared import blocks, give_back, ordered, rows_table, text_bytes
from textloom.llm.words import Words, mix

PIECE = "bucket int, block int, keys binary, more binary, ranks binary, places binary"
ANSWER = "bucket int, block int, found binary"


def first_of_runs(symbols: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (symbols[1:] != symbols[:-1]) | (text_of[1:] != text_of[:-1])])


def rounds(window: int) -> int:
    """A round makes symbols a third longer. They may grow to a sixth of a window: with longer ones a window has
    but one or two, which say too little about its other words, and more windows must be verified."""
    return max(1, int(math.log(window / 6, 4 / 3))) if window > 6 else 1


def levels(words: Words, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level, highest first: names, and the range of words that each depends on."""
    n = len(words.hash)
    place = np.arange(n)
    out = [(words.hash, place, place + 1)]
    if not n:
        return out
    begin = first_of_runs(words.hash, words.text_of)
    length = np.diff(np.r_[begin, n])
    names, text_of = words.hash[begin], words.text_of[begin]
    names = np.where(length > 1, mix(names * np.uint64(0xC2B2AE3D27D4EB4F) + length.astype(np.uint64)), names)
    lo, hi = begin - 1, begin + length + 1  # a run's bounds depend on the words beside it
    start, end = begin, begin + length
    out.append((names, lo, hi))
    for k in range(rounds(window)):
        left = (mix(names + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        joined = left[:-1] & ~left[1:] & (text_of[1:] == text_of[:-1])
        head, tail = np.zeros(len(names), bool), np.zeros(len(names), bool)
        head[:-1], tail[1:] = joined, joined
        inside = text_of[1:] == text_of[:-1]
        # A single symbol depends on the neighbour that it might have joined, or on the text's end.
        after, before = end + 1, start - 1
        after[:-1][inside], before[1:][inside] = hi[1:][inside], lo[:-1][inside]
        new_lo, new_hi = np.where(left | tail, lo, np.minimum(lo, before)), np.where(left & ~head, np.maximum(hi, after), hi)
        at = np.flatnonzero(head)
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        new_end = end.copy()
        new_end[at] = end[at + 1]
        new_names = names.copy()
        new_names[at] = mix(names[at] * np.uint64(0xFF51AFD7ED558CCD) + mix(names[at + 1]) + np.uint64(k + 1))
        stay = ~tail
        names, lo, hi, start, end, text_of = new_names[stay], new_lo[stay], new_hi[stay], start[stay], new_end[stay], text_of[stay]
        out.append((names, lo, hi))
    return out[::-1]


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For places 0 to n - 1, how many of the ranges lo to hi (inclusive) hold them."""
    return np.cumsum(np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi + 1, minlength=n + 2)[: n + 1])[:n]


class Anchors:
    """The consistent symbols of a block's windows: ``names`` are distinct and sorted."""

    def __init__(self, words: Words, window: int):
        n = len(words.hash)
        self.valid, self.layers = words.runs(window), []
        todo = self.valid.copy()
        for names, lo, hi in levels(words, window):
            if not todo.any():
                break
            first, last = np.maximum(hi - window, 0), np.minimum(lo, n - 1)
            sums = np.r_[0, np.cumsum(todo)]
            used = first <= last
            used[used] = sums[last[used] + 1] > sums[first[used]]
            names, first, last = names[used], first[used], last[used]
            count = covered(first, last, n)
            self.layers.append((names, first, last, todo & (count > 0), count))
            todo &= count == 0
        every = np.concatenate([x[0] for x in self.layers]) if self.layers else np.zeros(0, np.uint64)
        self.names, times = np.unique(every, return_counts=True)
        self.again = times > 1

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Where windows begin all of whose symbols are among the ``repeated`` (a mask of names)."""
        out = np.zeros(len(self.valid), bool)
        for names, first, last, own, count in self.layers:
            hit = repeated[np.searchsorted(self.names, names)]
            out |= own & (covered(first[hit], last[hit], len(out)) == count)
        return np.flatnonzero(out)


def window_digests(words: Words, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit BLAKE2b digest of the words themselves, joined by a space, of each window."""
    size = words.end - words.start + 1
    begin = np.cumsum(size) - size
    joined = np.append(words.data, np.uint8(32))[np.arange(begin[-1] + size[-1]) - np.repeat(begin - words.start, size)] if len(size) else words.data
    joined[begin + size - 1] = 32
    raw, last = memoryview(joined.tobytes()), places + window - 1
    digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin[places].tolist(), (begin[last] + size[last] - 1).tolist(), strict=True)]
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x)]


def packed(x: np.ndarray, kind: str) -> bytes:
    """Differences, which the shuffle's compression shortens."""
    return np.diff(x, prepend=x.dtype.type(0)).astype(kind).tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, kind).astype(np.int64))


def substring_dedup(docs: DataFrame, window: int = 20, keep_columns: bool = False, block_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, n_words, n_removed and kept_sha256 for every row; with ``keep_columns`` also
    ``rest``, a struct of the other columns. ``text`` is unchanged where nothing is removed, else the
    kept words joined by a space; kept_sha256 is of the kept words so joined in any case.

    A word goes when a window of ``window`` words over it also starts earlier: in a smaller doc_id,
    or earlier in the same document. Windows are judged on the input. A null or empty text has no
    words. A null doc_id is smaller than any other; such rows are taken in the order of a hash of their texts, and rows
    that repeat a doc_id in the order of their texts, the later ones as later. An empty table gives no rows.
    """
    n_bytes = text_bytes(docs)
    buckets = max(16, math.ceil(n_bytes / bucket_bytes))
    own = blocks(docs, n_bytes, block_bytes, keep_columns=keep_columns)

    def ask_symbols(table: pa.Table) -> pa.Table:
        anchors = Anchors(Words(ordered(table).column("text")), window)
        block = table.column("block")[0].as_py()
        keys = (anchors.names >> np.uint64(32)).astype("<u4")
        rows = [(b, block, keys[x].tobytes(), np.packbits(anchors.again[x]).tobytes(), None, None) for b, x in by_bucket((anchors.names & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets)]
        return rows_table(rows, PIECE)

    def count_symbols(table: pa.Table) -> pa.Table:
        give_back()
        keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("more").to_pylist(), keys, strict=True)]
        _, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        repeated = (times > 1) | (np.bincount(which, np.concatenate(again), len(times)) > 0)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        found = [np.packbits(x).tobytes() for x in np.split(repeated[which], cuts)]
        return pa.table([table.column("bucket"), table.column("block"), pa.array(found, pa.binary())], names=["bucket", "block", "found"])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        words = Words(table.column("text"))
        anchors, block = Anchors(words, window), table.column("block")[0].as_py()
        repeated, found = np.zeros(len(anchors.names), bool), dict(zip(answers.column("bucket").to_pylist(), answers.column("found").to_pylist(), strict=True))
        for b, x in by_bucket((anchors.names & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets):
            repeated[x] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=len(x))
        places = anchors.candidates(repeated)
        if not len(places):
            return rows_table([], PIECE)
        key, more = window_digests(words, places, window)
        order = np.lexsort((places, more, key))
        same = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
        later = places[order[1:][same]]
        first = np.sort(order[np.r_[True, ~same]])
        # What repeats inside the block returns to it under a key of its own.
        rows = [(-1 - block, block, None, None, None, packed(np.sort(later), "<u4"))] if len(later) else []
        key, more, places = key[first], more[first], places[first]
        row = words.text_of[places]
        named, rank, starts = table.column("named").to_numpy()[row], table.column("rank").to_numpy()[row], places - words.first[row]
        for b, x in by_bucket((more >> np.uint64(32)).astype(np.int64) % buckets):
            rows.append((b, block, key[x].tobytes(), more[x].tobytes(), packed(rank[x], "<i8") + packed(starts[x], "<i4") + np.packbits(named[x]).tobytes(), packed(places[x], "<u4")))
        return rows_table(rows, PIECE)

    def first_windows(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:  # found in their own block
            return table.select(["bucket", "block", "places"]).rename_columns(["bucket", "block", "found"])
        give_back()
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        more = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("more").to_pylist()])
        where = [(x, len(k)) for x, k in zip(table.column("ranks").to_pylist(), keys, strict=True)]
        rank = np.concatenate([unpacked(x[: 8 * n], "<i8") for x, n in where])
        starts = np.concatenate([unpacked(x[8 * n : 12 * n], "<i4") for x, n in where])
        named = np.concatenate([np.unpackbits(np.frombuffer(x[12 * n :], np.uint8), count=n) for x, n in where])
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        keys = np.concatenate(keys)
        order = np.lexsort((starts, rank, named, more, keys))
        earlier = np.zeros(len(keys), bool)
        earlier[order[1:]] = (keys[order][1:] == keys[order][:-1]) & (more[order][1:] == more[order][:-1])
        found = [packed(unpacked(p, "<u4")[e], "<u4") for p, e in zip(table.column("places").to_pylist(), np.split(earlier, cuts), strict=True)]
        return pa.table([table.column("bucket"), table.column("block"), pa.array(found, pa.binary())], names=["bucket", "block", "found"])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        words = Words(table.column("text"))
        found = [unpacked(x, "<u4") for x in answers.column("found").to_pylist()]
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        gone = covered(places, places + window - 1, len(words.start)) > 0 if len(places) else np.zeros(len(words.start), bool)
        kept, removed = kept_words(words, ~gone), np.diff(np.r_[0, np.cumsum(gone)][words.first])
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        old = table.column("text").to_pylist()
        text = [x.decode("utf-8") if r else o for x, r, o in zip(kept, removed, old, strict=True)]
        arrays = [table.column("doc_id"), pa.array(text, pa.string()), pa.array(np.diff(words.first)), pa.array(removed), pa.array(sha, pa.string())]
        names = ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]
        if "rest" in table.column_names:
            arrays, names = [*arrays, table.column("rest")], [*names, "rest"]
        return pa.table(arrays, names=names)

    symbols = own.groupBy("block").applyInArrow(ask_symbols, PIECE)
    repeated = symbols.groupBy("bucket").applyInArrow(count_symbols, ANSWER)
    windows = own.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(ask_windows, PIECE)
    answers = windows.groupBy("bucket").applyInArrow(first_windows, ANSWER)
    schema = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"
    if "rest" in own.columns:
        schema += f", rest {own.schema['rest'].dataType.simpleString()}"
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)


def kept_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """For each text, its kept words joined by a space."""
    start, end, text_of = words.start[keep], words.end[keep], words.text_of[keep]
    last = np.r_[text_of[1:] != text_of[:-1], True] if len(text_of) else np.zeros(0, bool)
    mask = covered(start, end - 1, len(words.data)) > 0 if len(start) else np.zeros(len(words.data), bool)
    data = words.data.copy()
    gaps = end[~last]
    data[gaps], mask[gaps] = 32, True
    size = np.bincount(text_of, end - start + ~last, len(words.first) - 1).astype(np.int64)
    raw, bounds = data[mask].tobytes(), np.r_[0, np.cumsum(size)]
    return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
