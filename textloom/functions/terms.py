"""Many terms looked for at once, in time that grows with the text and not with the number of terms.

The terms form a trie; a node's failure link leads to the node of its longest proper ending that is in the trie, so the text is read once and no
position twice. A node also knows the next term that ends where it does.
"""

from __future__ import annotations

import io
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.slices import over_slices

#: A task holds so many counts, or those of one slice more, before it sends them on.
HELD = 50_000
#: A glossary remembers so many runs of letters, of at most so many letters each.
KNOWN, SHORT = 30_000, 40
#: What an array says of letters where no term begins.
FREE, WITHIN = -1, -2


class Automaton:
    """Finds all places of ``terms``, which are distinct and not empty."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        for k, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                at = self.next[at][c]
            self.term[at] = k
        self.fail, self.ending = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, child in self.next[at].items():
                queue.append(child)
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
            back = self.fail[at]
            self.ending[at] = back if self.term[back] >= 0 else self.ending[back]

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, number of the term) of every place, also of those that overlap."""
        at = 0
        for i, c in enumerate(text):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            hit = at if self.term[at] >= 0 else self.ending[at]
            while hit:
                yield i + 1, self.term[hit]
                hit = self.ending[hit]


class Glossary:
    """Replaces terms as if one after the other, the longest first and those of one length in the order given."""

    def __init__(self, pairs: dict[str, str]):
        self.pairs = sorted(((k, v) for k, v in pairs.items() if k), key=lambda kv: -len(kv[0]))
        self.automaton = Automaton([k for k, _ in self.pairs])
        letters = {c for k, _ in self.pairs for c in k}
        # Where no term has a letter of a replacement, what was replaced is no part of a later place.
        self.apart = bool(letters) and not letters & {c for _, v in self.pairs for c in v} and all(v for _, v in self.pairs)
        # Then no place goes beyond a run of the terms' letters, so each run is replaced by itself, and short ones, which come again and again, are remembered.
        # A text's places are never held together.
        self.runs = re.compile(f"[{''.join(map(re.escape, sorted(letters)))}]+") if self.apart else None
        self.known = lru_cache(KNOWN)(self.in_turn)

    def apply(self, text: str) -> str:
        if self.apart:
            return self.runs.sub(lambda m: self.known(m[0]) if m.end() - m.start() <= SHORT else self.at_once(m[0]), text)
        if next(self.automaton.places(text), None):
            for k, v in self.pairs:
                text = text.replace(k, v)
        return text

    def in_turn(self, run: str) -> str:
        """A short run, which has few terms."""
        for k in sorted({k for _, k in self.automaton.places(run)}):
            run = run.replace(*self.pairs[k])
        return run

    def at_once(self, run: str) -> str:
        """A run of any length, in some ten bytes of memory for each letter."""
        found: dict[int, array] = {}
        for end, k in self.automaton.places(run):
            found.setdefault(k, array("q")).append(end - len(self.pairs[k][0]))
        if not found:
            return run
        # The number of the term that begins at a letter; FREE where none has been taken, WITHIN inside of one.
        taken = array("i", [FREE]) * len(run)
        for k in sorted(found):
            n = len(self.pairs[k][0])
            own = array("i", [k] + [WITHIN] * (n - 1))
            for begin in found.pop(k):
                # Both ends suffice: a longer term that was taken inside would have been longer than this one.
                if taken[begin] == FREE and taken[begin + n - 1] == FREE:
                    taken[begin : begin + n] = own
        out, last = io.StringIO(), 0
        for begin, k in enumerate(taken):
            if k >= 0:
                out.write(run[last:begin])
                out.write(self.pairs[k][1])
                last = begin + len(self.pairs[k][0])
        out.write(run[last:])
        return out.getvalue()


def glossary(pairs: dict[str, str]):
    """An Arrow function that applies a glossary to texts."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Glossary(pairs)
        for part in over_slices(batches):
            made, part = pa.array([None if t is None else own.apply(t) for t in part.to_pylist()], pa.string()), None
            yield made

    return run


def term_places(docs: DataFrame, terms: list[str], text: Column | str = "text") -> DataFrame:
    """(term, prev, next, n): how often each term stands between each two letters in the texts, empty at a line's end. Counts are added up
    in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = Automaton(terms), {}
        for part in over_slices(batches, "text"):
            for t in part.column("text").to_pylist():
                t = t or ""
                for end, k in automaton.places(t):
                    begin = end - len(terms[k])
                    before, after = t[begin - 1 : begin] if begin else "", t[end : end + 1]
                    key = (k, "" if before == "\n" else before, "" if after == "\n" else after)
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) >= HELD:
                yield counted(counts)
                counts = {}
        yield counted(counts)

    def counted(counts: dict[tuple[int, str, str], int]) -> pa.RecordBatch:
        columns = list(zip(*((terms[k], prev, after, n) for (k, prev, after), n in counts.items()), strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["term", "prev", "next", "n"])

    found = docs.select((F.col(text) if isinstance(text, str) else text).alias("text")).mapInArrow(run, "term string, prev string, next string, n long")
    return found.groupBy("term", "prev", "next").agg(F.sum("n").alias("n"))
