"""Exact dedup by an extendible-hash index, in DataFrame operations only.

The directory comes first, from the texts' hashes alone. It says how many leading bits of a hash name its
bucket: a bucket with more than ``capacity`` distinct hashes is split by one more bit, level by
level, until none is overfull; a split at the directory's own depth doubles it. Every text is then filed
in the bucket that the directory names for its hash. Within a bucket equal texts meet by their bytes;
each map task first folds its own copies together, so a text with very many copies travels once per
task. Texts whose hashes collide are links of one chain. The index is written to the shared folder,
each owner task having a range of buckets, hashes and links. Every row then goes by the directory to
its bucket and there along the chain of its hash to the link with its text's digest.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import staged

#: Buckets up to which the directory is sent to all tasks (about 20 MB); a larger one is joined as any table.
SMALL = 1 << 20
BUCKET = ["depth", "bits"]


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; all else stays, other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leading(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def hinted(buckets: DataFrame) -> DataFrame:
    return F.broadcast(buckets) if buckets.count() <= SMALL else buckets


def directory(hashes: DataFrame, capacity: int, first: int | None = None) -> tuple[DataFrame, list[int]]:
    """(depth, bits) of every bucket, its own depth and the leading bits of its hashes; and the depths that occur.

    It starts with 2 to the power ``first`` slots, or else with a quarter to a half of those that as many hashes need, so that the number of
    doublings does not grow with them. Hashes count once, so copies and collisions split nothing.
    """
    left, found, depths = staged(hashes.select("h").distinct(), "hashes"), [], []
    depth = first if first is not None else max(0, int(math.log2(max(1, left.count() / capacity))) - 1)
    while True:
        sizes = staged(left.groupBy(leading(F.col("h"), depth).alias("bits")).agg(F.count(F.lit(1)).alias("held")), "sizes")
        ready, full = sizes.where(F.col("held") <= capacity), sizes.where(F.col("held") > capacity)
        if not found or not ready.isEmpty():
            found.append(ready.select(F.lit(depth).alias("depth"), "bits"))
            depths.append(depth)
        if full.isEmpty():
            return staged(reduce(DataFrame.unionByName, found), "directory"), depths
        left = left.join(hinted(full.select("bits")), leading(F.col("h"), depth) == F.col("bits"), "left_semi")
        depth += 1


def filed(rows: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` with the bucket that the directory has for their hash ``h``: of a hash's slots, one at
    each depth, exactly one is a bucket."""
    slots = F.array(*(F.struct(F.lit(d).alias("depth"), leading(F.col("h"), d).alias("bits")) for d in depths))
    return rows.select("*", F.inline(slots)).join(hinted(buckets), BUCKET)


def exact_dedup(docs: DataFrame, capacity: int = 128, owner_rows: int = 1 << 16, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    Texts are equal when they are after lower-casing A-Z; of equal texts the largest doc_id stays.
    Null counts as the empty text. A null doc_id is smaller than any other; a group of nothing but
    null doc_ids has a null keep_id and its rows stay. Rows that repeat both doc_id and text count
    in group_size and share one fate. An empty table gives no rows; other columns are ignored.
    ``capacity``: the hashes of a bucket, some 8 KB; ``owner_rows``: the links that an owner task writes.
    ``hash_of`` gives the 64-bit hash of a text; collisions cost time, never a wrong result.
    """
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    digest = F.sha2(F.encode("norm", "utf-8"), 256).alias("sha")
    probes = staged(texts.select("doc_id", "h", digest), "probes")
    buckets, depths = directory(probes, capacity)
    links = filed(texts, buckets, depths).groupBy(*BUCKET, "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = staged(links.select(*BUCKET, "h", digest, "keep_id", "group_size"), "entries")
    owners = max(1, -(-entries.count() // owner_rows))
    index = staged(entries.repartitionByRange(owners, *BUCKET, "h", "sha").sortWithinPartitions(*BUCKET, "h", "sha"), "index")
    found = filed(probes, buckets, depths).join(index, [*BUCKET, "h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
