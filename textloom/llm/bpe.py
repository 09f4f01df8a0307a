"""BPE encoding and decoding with a pair occurrence index.

Texts are normalised and split into pre-tokens as the tokenizer file says. The distinct pre-tokens
that a partition has not met before are laid out in one symbol array; an index maps each pair of
neighbours that has a rank to all its positions there, the active ranks are applied in ascending
order, and every merge updates the lists of the pairs beside it. Texts are then written from the
encodings of their blank-separated pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.packing import byte_letters

#: Characters on whose classes, cases and composition all libraries agree.
PLAIN = re.compile(r"[^\t\n\x20-\x7eÀ-ÖØ-öø-ɏ]")
CACHE = 400_000

_MODELS: dict[str, "WordBpe"] = {}


class WordBpe:
    """A BPE model whose words end in a suffix, read from a tokenizer file with NFC, lower case and a
    removing split before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.size = len(self.ids)
        pairs = np.array([a * self.size + b for a, b, _ in self.merges], np.int64)
        self.pairs, self.pair_ranks = np.unique(pairs, return_index=True)
        self.tokens = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.digits = {i: str(i) for i in self.tokens}
        self.written: tuple[dict[str, str], dict[str, str]] = {}, {}

    def symbols(self, word: str) -> list[int]:
        own = [self.letters[b] for b in word.encode("utf-8")]
        own[-1] += self.suffix
        return [self.ids[x] for x in own]

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, or -1."""
        pairs = a * self.size + b
        k = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where((self.pairs[k] == pairs) & (a >= 0) & (b >= 0), self.pair_ranks[k], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by one pair index over all of them."""
        symbols = [self.symbols(w) for w in words]
        length = np.array([len(x) + 1 for x in symbols], np.int64)
        at = np.fromiter((x for own in symbols for x in (*own, -1)), np.int64, length.sum())  # -1 ends a word
        n = len(at)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        first = self.ranked(at[:-1], at[1:])
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        index = {int(first[x[0]]): [x] for x in np.split(order, cuts) if len(x)}  # rank: positions
        later: dict[int, list[int]] = {}
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.merges[rank]
            places = np.unique(np.concatenate([*index.pop(rank, []), np.array(later.pop(rank, []), np.int64)]))
            places = places[at[places] == a]
            places = places[at[after[places]] == b]  # an earlier merge may have taken one of the two
            if a == b:
                places = self.apart(places, after)
            if not len(places):
                continue
            taken = after[places]
            at[places], at[taken] = new, -2
            beyond = after[taken]
            after[places], before[beyond] = beyond, places
            left = before[places]
            for where, ranks in ((left, self.ranked(np.where(left >= 0, at[left], -1), at[places])), (places, self.ranked(at[places], at[beyond]))):
                hit = ranks >= 0
                for r, place in zip(ranks[hit].tolist(), where[hit].tolist(), strict=True):
                    if r in later:
                        later[r].append(place)
                    else:
                        later[r] = [place]
                        if r not in index:
                            heapq.heappush(active, r)
        stay = at >= 0
        ids, ends = at[stay].tolist(), np.cumsum(stay)[np.cumsum(length) - 1].tolist()
        return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping positions of a pair of equal symbols, those that leftmost-first merging takes."""
        kept, barred = [], -1
        for place, other in zip(places.tolist(), after[places].tolist(), strict=True):
            if place != barred:
                kept.append(place)
                barred = other
        return np.array(kept, np.int64)

    def learn(self, words: set[str]) -> None:
        """Writes down the ids and the tokens of words, both joined by spaces."""
        as_ids, as_tokens = self.known
        if len(as_ids) > CACHE:
            as_ids.clear()
            as_tokens.clear()
        new = [w for w in words if w not in as_ids]
        for w, ids in zip(new, self.merge(new) if new else [], strict=True):
            as_ids[w] = " ".join([self.digits[i] for i in ids])
            as_tokens[w] = " ".join([self.tokens[i] for i in ids])

    def plain_words(self, piece: str) -> list[str]:
        return self.split.findall(piece.lower())

    def any_words(self, text: str) -> list[str | int]:
        """Words and special ids of a text of any characters, split by the library's own classes."""
        out: list[str | int] = []
        at = 0
        for m in [*self.special.finditer(text), None]:
            part = self.normalise(text[at : m.start() if m else len(text)])
            out += [part[a:b] for _, (a, b) in self.pieces(part)]
            if m:
                out.append(self.specials[m[0]])
                at = m.end()
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: how many ids, the ids and the tokens, both joined by spaces."""
        as_ids, as_tokens = self.written
        if len(as_ids) > CACHE:
            as_ids.clear()
            as_tokens.clear()
        odd, rows, new = {}, [], {}
        for k, text in enumerate(texts):
            if PLAIN.search(text) or self.special.search(text):
                odd[k] = self.any_words(text)
                rows.append([])
            else:
                rows.append(text.split())
                for piece in set(rows[-1]):
                    if piece not in as_ids and piece not in new:
                        new[piece] = self.plain_words(piece)
        self.learn({w for words in [*new.values(), *odd.values()] for w in words if isinstance(w, str)})
        known_ids, known_tokens = self.known
        for piece, words in new.items():
            as_ids[piece] = " ".join([known_ids[w] for w in words])
            as_tokens[piece] = " ".join([known_tokens[w] for w in words])
        for k, pieces in enumerate(rows):
            if k in odd:
                ids = " ".join([known_ids[w] if isinstance(w, str) else self.digits[w] for w in odd[k]])
                tokens = " ".join([known_tokens[w] if isinstance(w, str) else self.tokens[w] for w in odd[k]])
            else:
                ids, tokens = " ".join(map(as_ids.__getitem__, pieces)), " ".join(map(as_tokens.__getitem__, pieces))
            yield ids.count(" ") + 1 if ids else 0, ids, tokens


def model(path: str) -> WordBpe:
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def bpe(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row; with ``keep_ids`` also the ids
    and the decoded text.

    Special tokens in a text are encoded as such, and decoding keeps them. Null and empty texts have
    no tokens and decode to the empty text. Null and repeated doc_ids are kept as they are; an empty
    table gives no rows; other columns are ignored; texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, ids, decoded, texts = [], [], [], [[], []]
                for count, a, b in own.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                    n.append(count)
                    ids.append(hashlib.sha256(a.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b.encode()).hexdigest())
                    if keep_ids:
                        texts[0].append([int(x) for x in a.split()])
                        texts[1].append(b)
                arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(texts[0], pa.list_(pa.int32())), pa.array(texts[1], pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
