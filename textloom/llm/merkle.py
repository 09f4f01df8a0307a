"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Trees are built bottom up from events. Every row's digest is an event with its place; a partial parent gathers the digests of its
children by place, and when it has as many as its place and the size of its level call for, its own digest is the next event. Each
task does so for the rows it holds, so that nearly all parents are finished where their leaves are. What remains open
there, two or three parents a level and task, is the frontier: it is shuffled by parent and combined, and parents that are
finished by this send their digest to their own parent in the next round, until none is open.

Proofs go the other way: from the root down, each finished parent hands its children the digests beside them and its own
path. Rows meet their lowest parent by its place, so no group's size matters to any task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textloom.llm.ordering import before, parts_for, ranged
from textloom.llm.shared import staged

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CHILD = pa.struct([("slot", pa.int32()), ("digest", pa.string())])
NODE = "tree string, level int, parent long, size long, children array<struct<slot:int,digest:string>>, digest string"
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its UTF-8 byte count, a colon and itself, or ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with their position in their tree and the tree's size, as ``pos`` and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            local = []
            for tree in batch.column("tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                local.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])

    sorted_rows = ranged(rows, [F.col("tree"), *order], parts).withColumn("part", F.spark_partition_id())
    placed = staged(sorted_rows.mapInArrow(run, StructType([*sorted_rows.schema.fields, StructField("local", LongType())])), "leaves")
    totals = before(placed.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows")), ["tree"], ["part"], "rows", "base")
    totals = staged(totals.withColumn("n", F.sum("rows").over(Window.partitionBy("tree"))), "totals")
    return placed.join(totals, ["part", "tree"]).withColumn("pos", F.col("base") + F.col("local")).drop("part", "local", "rows", "base")


def grown(rows: DataFrame, arity: int) -> DataFrame:
    """All parents above ``rows`` (tree, pos, n, digest): tree, level, parent (its place there), size (of the level below), its children and its digest."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, tuple[int, dict[int, str]]] = {}
        for batch in batches:
            out = []
            for tree, pos, n, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "pos", "n", "digest")), strict=True):
                level = 0
                while n > 1:
                    parent, slot = divmod(pos, arity)
                    _, held = partial.setdefault((tree, level, parent), (n, {}))
                    held[slot] = digest
                    if len(held) < min(arity, n - arity * parent):
                        break
                    del partial[tree, level, parent]
                    digest = hashlib.sha256("".join(held[k] for k in sorted(held)).encode()).hexdigest()
                    out.append((tree, level, parent, n, held, digest))
                    pos, n, level = parent, -(-n // arity), level + 1
            yield nodes_batch(out)
        yield nodes_batch([(*key, n, held, None) for key, (n, held) in partial.items()])

    found = staged(rows.select("tree", "pos", "n", "digest").mapInArrow(combine, NODE), "nodes")
    done, open_ = [found.where("digest IS NOT NULL")], found.where("digest IS NULL")
    while True:
        # At most ``arity`` children meet for a parent, whatever the size of its tree.
        merged = open_.groupBy("tree", "level", "parent", "size").agg(F.array_sort(F.flatten(F.collect_list("children"))).alias("children"))
        whole = F.size("children") == F.least(F.lit(arity), F.col("size") - arity * F.col("parent"))
        merged = staged(merged.withColumn("digest", F.when(whole, F.sha2(F.array_join("children.digest", ""), 256))).select(*found.columns), "frontier")
        done.append(merged.where("digest IS NOT NULL"))
        onward = merged.where((F.col("digest").isNotNull()) & (F.col("size") > arity))
        if onward.isEmpty():
            break
        child = F.array(F.struct((F.col("parent") % arity).cast("int").alias("slot"), F.col("digest")))
        events = onward.select("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("parent") / arity).alias("parent"), F.ceil(F.col("size") / arity).alias("size"), child.alias("children"), F.lit(None).cast("string").alias("digest"))
        open_ = merged.where("digest IS NULL").unionByName(events)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return staged(every, "tree")


def nodes_batch(rows: list[tuple]) -> pa.RecordBatch:
    slots, digests, offsets = [], [], [0]
    for row in rows:
        slots += (order := sorted(row[4]))
        digests += [row[4][k] for k in order]
        offsets.append(len(slots))
    children = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(slots, pa.int32()), pa.array(digests, pa.string())], fields=list(CHILD)))
    arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*arrays, children, pa.array([r[5] for r in rows], pa.string())], names=["tree", "level", "parent", "size", "children", "digest"])


def step(children: Column, slot: Column) -> Column:
    """The digests before and after a child among its parent's children."""
    joined = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")
    return F.struct(joined(lambda c: c["slot"] < slot).alias("left"), joined(lambda c: c["slot"] > slot).alias("right"))


def proven(rows: DataFrame, nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """``rows`` with the columns of ``above`` (one row a tree: tree, steps and others), where ``steps`` now starts at the row.

    A level's parents are linked to the level above them by their place, from the top down."""
    others = [F.col(f"a.{c}").alias(c) for c in above.columns if c not in ("tree", "steps")]
    linked = None
    for level in range((nodes.agg(F.max("level")).first()[0] or 0), -1, -1):
        own = nodes.where(F.col("level") == level).select("tree", "parent", "size", "children")
        top = own.where(F.col("size") <= arity).alias("o").join(above.alias("a"), "tree").select("tree", "o.parent", "o.children", F.col("a.steps").alias("steps"), *others)
        if linked is not None:
            lower = own.where(F.col("size") > arity).withColumn("up", F.floor(F.col("parent") / arity)).alias("o")
            upper = linked.withColumnRenamed("parent", "up").withColumnRenamed("children", "beside").alias("a")
            steps = F.concat(F.array(step(F.col("a.beside"), F.col("o.parent") % arity)), F.col("a.steps"))
            top = top.unionByName(lower.join(upper, ["tree", "up"]).select("tree", "o.parent", "o.children", steps.alias("steps"), *others))
        linked = top
    columns = [c for c in rows.columns if c not in ("pos", "n")]
    alone = rows.where("n = 1").alias("r").join(above.alias("a"), "tree").select(*columns, F.col("a.steps").alias("steps"), *others)
    many = rows.where("n > 1").withColumn("up", F.floor(F.col("pos") / arity)).alias("r").join(linked.withColumnRenamed("parent", "up").alias("a"), ["tree", "up"])
    steps = F.concat(F.array(step(F.col("a.children"), F.col("r.pos") % arity)), F.col("a.steps"))
    return alone.unionByName(many.select(*columns, steps.alias("steps"), *others))


def roots(rows: DataFrame, nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, digest): that of the parent of all, or of the only leaf."""
    return nodes.where(F.col("size") <= arity).select("tree", "digest").unionByName(rows.where("n = 1").select("tree", "digest"))


def merkle(docs: DataFrame, arity: int = 16, keep: tuple[str, ...] = (), part_rows: int = 100_000) -> DataFrame:
    """doc_id, leaf, subroot, root and steps for every row, and the columns named in ``keep``.

    A leaf is the digest of doc_id, source, lang, n_chars and text; leaves of a source ascend by doc_id, a null first, and
    ties by their own digests, so that repeated rows are leaves beside each other. Every ``arity`` neighbours, the last run fewer, become their digest until one is left;
    these subroots, in the order of their source (null first, by bytes), give the root alike. ``steps`` has for each level from the leaf up the joined digests
    before and after the own one. A text of any length is reduced to its digest where it is read. An empty table gives no rows. Other columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    # A null source is a tree of its own and sorts before all others.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), F.struct(F.lit(0).alias("none"), *(F.col(c) for c in keep)).alias("kept"))
    leaves = numbered(rows, [F.col("doc_id"), F.col("digest")], parts_for(docs.count(), part_rows))
    nodes = grown(leaves, arity)
    subroots = roots(leaves, nodes, arity).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = staged(numbered(subroots, [F.col("source")], 1 if (many := nodes.where(F.col("size") <= arity).count()) < part_rows else parts_for(many, part_rows)), "sources")
    tops = grown(sources, arity)
    root = roots(sources, tops, arity).select("tree", F.expr(f"CAST(array() AS {STEPS})").alias("steps"), F.col("digest").alias("root"))
    above = proven(sources, tops, root, arity).select(F.col("source").alias("tree"), "steps", "root", F.col("digest").alias("subroot"))
    found = proven(leaves, nodes, staged(above, "subroots"), arity)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", *(F.col("kept")[c].alias(c) for c in keep))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the digests beside its path."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, in order."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)
