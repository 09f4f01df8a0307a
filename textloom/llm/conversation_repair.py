"""Repair of the order of roles in conversations by a scan of min-plus matrices.

A repaired conversation has the role initials ``(s?(ua)+)?``: a machine with four states reads them (start, after the system turn,
after a user turn, after an assistant turn). Every turn is a 4 x 4 matrix over pairs of cost and audit: its element (i, j) is the cheapest way to
get from state i to state j by editing this turn and inserting any turns after it, and of equally cheap ways that whose
audit comes first. The sum of two such pairs joins them, and the least of several is taken, so matrices can be
multiplied in any grouping. (Two audits of equal cost for the same turns and states are never one the start of the other: what follows the
shorter would be inserts, which cost. So joining keeps their order, and the product is associative.)

Rows are sorted by conversation and turn over range partitions, and a conversation may end in another partition than it begins. One that
lies inside a partition is repaired there. Of the others each partition holds a block: blocks say which texts they were
first to hold, become matrices and totals, and are reduced by a tree of products; the cheapest audit then goes back, cut
at the blocks, and each block writes its part. No task holds more of a conversation's texts than a partition's share; its audit, a letter a
turn, is one value.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.ordering import parts_for, ranged
from textloom.llm.shared import staged

STATES = range(4)
#: Where each role initial leads from a state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def least(ways: Iterator[tuple[int, str] | None]) -> tuple[int, str] | None:
    return min((w for w in ways if w), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """Joining is the product and taking the least the sum."""
    return tuple(tuple(least((x[0] + y[0], x[1] + y[1]) for k in STATES if (x := a[i][k]) and (y := b[k][j])) for j in STATES) for i in STATES)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(least((a[i][j], b[i][j])) for j in STATES) for i in STATES)


def along(initials: str, cost: int, letter: str) -> Matrix:
    """From each state where one of the initials leads."""
    return tuple(tuple((cost, letter) if any(STEPS[c].get(i) == j for c in initials if c in STEPS) else None for j in STATES) for i in STATES)


ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in STATES) for i in STATES)


@functools.cache
def inserts() -> Matrix:
    """Any number of inserted turns: more than three would pass a state again."""
    once, out = along("ua", INSERT, "I"), ONE
    for _ in STATES:
        out = plus(ONE, times(out, once))
    return out


@functools.cache
def turn_matrix(kind: str) -> Matrix:
    """``kind``: x for a turn that must go, else its role initial (o for any that leads nowhere), upper case if it is truncated."""
    out = tuple(tuple((DELETE, "D") if i == j else None for j in STATES) for i in STATES)
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        out = plus(out, plus(along(kind.lower(), more, "K"), along("ua", REROLE + more, "R")))
    return times(out, inserts())


def product(kinds: str) -> Matrix:
    """Of all turns, halves first."""
    return short(kinds) if len(kinds) <= 16 else times(product(kinds[: len(kinds) // 2]), product(kinds[len(kinds) // 2 :]))


@functools.lru_cache(10_000)
def short(kinds: str) -> Matrix:
    return ONE if not kinds else turn_matrix(kinds) if len(kinds) == 1 else times(short(kinds[: len(kinds) // 2]), short(kinds[len(kinds) // 2 :]))


def cheapest(turns: Matrix) -> tuple[int, str]:
    """Of the ways from the start to an end at which a conversation may stop, inserts before the first turn included."""
    return least(times(inserts(), turns)[0][j] for j in (0, 3))


class Totals(NamedTuple):
    """Of consecutive rows. ``first`` and ``last`` are role initials, null where there is no row."""

    n: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    least_turn: int | None = None
    most_turn: int | None = None
    turns: int = 0

    def then(self, o: Totals) -> Totals:
        if not self.n or not o.n:
            return self if self.n else o
        known = self.turns and o.turns
        return Totals(
            self.n + o.n, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal + (self.last + o.first not in LEGAL), self.first, o.last,
            self.least_turn if self.turns else o.least_turn, o.most_turn if o.turns else self.most_turn, self.turns + o.turns - (1 if known and self.most_turn == o.least_turn else 0),
        )

    def gaps(self) -> int:
        return self.most_turn - self.least_turn + 1 - self.turns if self.turns else 0


def examined(rows: list[tuple], seen: set[tuple[str, str]]) -> tuple[str, Totals]:
    """The kind of each row (turn, role, text, key) as a letter, and their totals; ``seen``: roles and keys of earlier rows."""
    kinds, blank, duplicate, truncated = [], 0, 0, 0
    for _, role, text, key in rows:
        body = text.strip(BLANKS)
        if not body:
            blank += 1
            kinds.append("x")
        elif (role, key) in seen:
            duplicate += 1
            kinds.append("x")
        else:
            kind = role[:1] if role[:1] in STEPS else "o"
            cut = body[-1] not in ".!?"
            truncated += cut
            kinds.append(kind.upper() if cut else kind)
        seen.add((role, key))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    ends = (initials[0], initials[-1]) if rows else (None, None)
    return "".join(kinds), Totals(len(rows), blank, duplicate, truncated, illegal, *ends, min(turns, default=None), max(turns, default=None), len(set(turns)))


def moved(state: int, letter: str, kind: str) -> tuple[int, str]:
    """The next state, and the role initial by which it is reached; ``kind`` is the kept row's."""
    c = kind.lower() if letter == "K" else "a" if state == 2 else "u"
    return STEPS[c][state], c


def applied(audit: str, rows: list[tuple], kinds: str, state: int = 0) -> list[tuple[str, str]]:
    """The repaired turns (role, text)."""
    out, at = [], 0
    for letter in audit:
        if letter != "D":
            state, c = moved(state, letter, kinds[at] if letter == "K" else "")
            out.append((rows[at][1] if letter == "K" else ROLES[c], "" if letter == "I" else rows[at][2]))
        at += letter != "I"
    return out


LINES = "array<struct<role:string,text:string>>"
TOTALS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, least_turn long, most_turn long, turns long"
ROW = "turn long, role string, text string, key string, present boolean"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FOUND = f"conv_id long, part int, seq long, row struct<{', '.join(x.replace(' ', ':') for x in ROW.split(', '))}>, report struct<{', '.join(x.replace(' ', ':') for x in REPORT.split(', '))}>, lines {LINES}"
BLOCK = f"cid string, conv_id long, part int, kinds string, costs array<long>, audits array<string>, {TOTALS}"


def lines_hash(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode("utf-8", "surrogatepass")).hexdigest()


def report_of(totals: Totals, cost: int, audit: str, sha: str | None) -> dict:
    return {"gaps": totals.gaps(), "blank": totals.blank, "duplicate": totals.duplicate, "truncated": totals.truncated, "illegal": totals.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations that begin and end inside a partition, and the rows of its first and last."""
    from pyspark import TaskContext

    part, out, held, conv, first, seq = TaskContext.get().partitionId(), [], [], None, True, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def raw(row: tuple) -> dict:
        nonlocal seq
        seq += 1
        return {"conv_id": conv, "part": part, "seq": seq, "row": dict(zip(("turn", "role", "text", "key", "present"), row, strict=True))}

    schema = arrow_schema()
    started = False
    for rows in batches:
        for conv_id, *row in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "key", "present")), strict=True):
            if not started or conv_id != conv:
                if started and not first:
                    own = [r[:4] for r in held if r[4]]
                    kinds, totals = examined(own, set())
                    cost, audit = cheapest(product(kinds))
                    lines = applied(audit, own, kinds)
                    out.append({"conv_id": conv, "part": part, "seq": 0, "report": report_of(totals, cost, audit, lines_hash(lines)), "lines": [{"role": r, "text": t} for r, t in lines]})
                first, started, conv, held = not started, True, conv_id, []
            if first:  # it may have begun before
                out.append(raw(tuple(row)))
            else:
                held.append(tuple(row))
            if len(out) >= 2000:
                yield batch()
                out = []
    out += [raw(r) for r in held]  # it may go on
    yield batch()


def arrow_schema() -> pa.Schema:
    lines = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    struct = lambda spec: pa.struct([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("row", struct(ROW)), ("report", struct(REPORT)), ("lines", lines)])


def block_rows(table: pa.Table) -> list[tuple]:
    """The present rows (turn, role, text, key) of a block in their order."""
    table = table.sort_by("seq")
    rows = zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text", "key", "present")), strict=True)
    return [r[:4] for r in rows if r[4]]


def block_table(rows: list[tuple[str, int | None, int, str | None, Matrix, Totals]]) -> pa.Table:
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3]
    flat = [(c, i, p, k, [x[0] if x else None for r in m for x in r], [x[1] if x else None for r in m for x in r], *t) for c, i, p, k, m, t in rows]
    return pa.table([pa.array([r[k] for r in flat], kind) for k, kind in enumerate(types)], names=[x.split()[0] for x in BLOCK.split(", ")])


def as_matrix(costs: list, audits: list) -> Matrix:
    pairs = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(pairs[4 * i : 4 * i + 4]) for i in STATES)


def to_block(key: tuple, table: pa.Table, earlier: pa.Table) -> pa.Table:
    rows = block_rows(table)
    kinds, totals = examined(rows, set(zip(earlier.column("role").to_pylist(), earlier.column("key").to_pylist(), strict=True)))
    return block_table([(key[0].as_py(), table.column("conv_id")[0].as_py(), key[1].as_py(), kinds, product(kinds), totals)] if table.num_rows else [])


def reduced(key: tuple, table: pa.Table) -> pa.Table:
    """Neighbouring blocks as one."""
    rows = table.sort_by("part").to_pylist()
    matrix, totals = ONE, Totals()
    for r in rows:
        matrix, totals = times(matrix, as_matrix(r["costs"], r["audits"])), totals.then(Totals(*(r[c] for c in Totals._fields)))
    return block_table([(key[0].as_py(), rows[0]["conv_id"], key[1].as_py(), None, matrix, totals)])


def report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit = cheapest(as_matrix(r["costs"], r["audits"]))
            out.append({"cid": r["cid"], "conv_id": r["conv_id"], **report_of(Totals(*(r[c] for c in Totals._fields)), cost, audit, None)})
        names = ["cid", "conv_id", *(x.split()[0] for x in REPORT.split(", "))]
        types = [pa.string(), pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)


def shares(key: tuple, blocks: pa.Table, reports: pa.Table) -> pa.Table:
    """The audit cut at the blocks' ends, with the state in which each begins; inserts go with the turn before them."""
    audit, at, state, out = reports.column("audit")[0].as_py(), 0, 0, []
    for r in blocks.sort_by("part").to_pylist():
        begin, begun, row = at, state, 0
        while at < len(audit) and (row < r["n"] or audit[at] == "I"):
            if audit[at] != "D":
                state, _ = moved(state, audit[at], r["kinds"][row] if audit[at] == "K" else "")
            row += audit[at] != "I"
            at += 1
        out.append((key[0].as_py(), r["part"], audit[begin:at], begun, r["kinds"]))
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["cid", "part", "audit", "state", "kinds"])


def written(key: tuple, table: pa.Table, share: pa.Table) -> pa.Table:
    lines = applied(share.column("audit")[0].as_py(), block_rows(table), share.column("kinds")[0].as_py(), share.column("state")[0].as_py())
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    arrays = [pa.array([key[0].as_py()]), table.column("conv_id").slice(0, 1).combine_chunks(), pa.array([key[1].as_py()], pa.int32()), pa.array([[{"role": r, "text": t} for r, t in lines]], kind)]
    return pa.table(arrays, names=["cid", "conv_id", "part", "lines"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sha) of pieces that come in order: a text at a time is held, whatever the length of a conversation."""
    last, sha, empty = None, hashlib.sha256(), True
    for batch in batches:
        out = []
        for cid, lines in zip(batch.column("cid").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if cid != last:
                if last is not None:
                    out.append((last, sha.hexdigest()))
                last, sha, empty = cid, hashlib.sha256(), True
            for line in lines:
                sha.update(("" if empty else "\n").encode() + f"{line['role']}:{line['text']}".encode("utf-8", "surrogatepass"))
                empty = False
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=["cid", "sha"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([sha.hexdigest()])], names=["cid", "sha"])


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new ids, so that Spark can tell them from those they come from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def repair(turns: DataFrame, present: Column | None = None, part_bytes: int = 16 << 20, least_parts: int = 12, fan_in: int = 16) -> tuple[DataFrame, DataFrame]:
    """Reports (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation, and the repaired turns
    (conv_id, part, at, role, text), in order of part and at.

    Turns are rows (conv_id, turn, role, text); null roles and texts are one blank. Rows where ``present`` is false only
    say that there is such a conversation. A conversation's rows come by turn, nulls first, then by role and by the digest of the text. A null
    conv_id is a conversation. One without any row has zeros, an empty audit and the hash of the empty string. A conversation or text of any length is taken whole.
    An empty table gives no rows. Other columns are ignored.
    """
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        F.coalesce(present if present is not None else F.lit(True), F.lit(True)).alias("present"),
    ).withColumn("key", F.sha2("text", 256))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = parts_for(n_bytes, part_bytes, least_parts)
    found = staged(ranged(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("key")], parts).mapInArrow(local, FOUND), "conversations")

    whole = found.where("row IS NULL")
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    open_ = found.where("row IS NOT NULL").select(cid.alias("cid"), "conv_id", "part", "seq", "row.*")
    held = open_.where("present").groupBy("cid", "part", "role", "key").agg(F.count(F.lit(1)).alias("copies"))
    firsts = renewed(held).groupBy("cid", "role", "key").agg(F.min("part").alias("first"))
    earlier = held.join(firsts, ["cid", "role", "key"]).where("part > first").select("cid", "part", "role", "key")
    earlier = renewed(earlier)
    blocks = staged(open_.groupBy("cid", "part").cogroup(earlier.groupBy("cid", "part")).applyInArrow(to_block, BLOCK), "blocks")
    tree = blocks
    for _ in range(max(1, math.ceil(math.log(max(2, blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1), fan_in)))):
        up = tree.withColumn("up", F.floor(F.col("part") / fan_in).cast("int"))
        tree = up.groupBy("cid", "up").applyInArrow(reduced, BLOCK)
    reports = staged(tree.mapInArrow(report_rows, f"cid string, conv_id long, {REPORT}"), "reports")
    split = renewed(blocks).groupBy("cid").cogroup(reports.groupBy("cid")).applyInArrow(shares, "cid string, part int, audit string, state int, kinds string")
    pieces = staged(open_.groupBy("cid", "part").cogroup(split.groupBy("cid", "part")).applyInArrow(written, f"cid string, conv_id long, part int, lines {LINES}"), "pieces")
    sha = pieces.select("cid", "part", "lines").repartition("cid").sortWithinPartitions("cid", "part").mapInArrow(hashed, "cid string, sha string")
    far = reports.join(sha, "cid").withColumn("repaired_sha256", F.col("sha")).drop("cid", "sha")
    line = lambda df: df.select("conv_id", "part", F.posexplode("lines").alias("at", "line")).select("conv_id", "part", "at", "line.role", "line.text")
    return whole.select("conv_id", "report.*").unionByName(far), line(whole).unionByName(line(pieces))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """``turns`` with known faults by the CRC of ``conv_id:turn`` modulo 20, and which rows are still there: 0 drops a row, 1 empties its text, 2
    removes its ends of sentences, 3 repeats it and 4 makes it the user's. Nulls are one blank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(said("role")))
    again = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("again", again).select("conv_id", "turn", "role", "text", "fault"), F.col("fault") != 0
