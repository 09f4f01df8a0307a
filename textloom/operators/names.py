"""Mining of recurring Han names: a surname and one or two letters, kept where the context varies.

Candidates are found text by text (none spans a line), everything else is counting, so a corpus of any
size is mined by a few aggregations. Surnames, function letters, titles and word frequencies are
inputs, as tables or sets; frequencies that are missing count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Set

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.slices import over_slices
from textloom.functions.terms import HELD, term_places
from textloom.sources.scratch import written

HAN = "一-鿿"
FOUND = "base string, full string, prev string, n long, first_doc long, first_pos long"
#: Names that one pass looks for: an automaton of them has some tens of megabytes.
PASS_NAMES = 100_000


def candidates(docs: DataFrame, single: Set[str], double: Set[str]) -> DataFrame:
    """(base, full, prev, n, first_doc, first_pos): how often each match stands behind each letter, and where first. ``base`` has one given
    letter, ``full`` two or none; matches are counted in each task, so a common name is a row for many texts."""
    surname = "|".join([*map(regex.escape, sorted(double)), "[" + "".join(map(regex.escape, sorted(single))) + "]"])
    pattern = regex.compile(f"({surname})([{HAN}]{{1,2}})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for part in over_slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for m in pattern.finditer(text or ""):
                    key = (m[1] + m[2][0], m[0] if len(m[2]) == 2 else None, text[m.start() - 1] if m.start() else "")
                    if key in found:
                        found[key][0] += 1
                        found[key][1] = min(found[key][1], (doc_id, m.start()))
                    else:
                        found[key] = [1, (doc_id, m.start())]
            if len(found) >= HELD:
                yield counted(found)
                found = {}
        yield counted(found)

    def counted(found: dict[tuple, list]) -> pa.RecordBatch:
        columns = list(zip(*((*key, n, *first) for key, (n, first) in found.items()), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], names=["base", "full", "prev", "n", "first_doc", "first_pos"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
    first = F.min(F.struct("first_doc", "first_pos"))
    return rows.groupBy("base", "full", "prev").agg(F.sum("n").alias("n"), first["first_doc"].alias("first_doc"), first["first_pos"].alias("first_pos"))


def followers(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, top, share) of the letter that most often follows each name in its line, by one automaton over all names; where there are more
    than PASS_NAMES, the texts are read once for each so many."""
    named = written(names.select("name").distinct(), "names")
    passes = max(1, -(-named.count() // PASS_NAMES))
    hits = None
    for k in range(passes):
        own = [r[0] for r in named.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k).collect()]
        found = term_places(docs, sorted(own))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy(F.col("term").alias("name"), "next").agg(F.sum("n").alias("n"))
    return hits.groupBy("name").agg(F.max_by("next", F.struct("n", "next")).alias("top"), (F.max("n") / F.sum("n")).alias("share"))


def mine(docs: DataFrame, single: Set[str], double: Set[str], determiners: Set[str], function: Set[str], titles: Set[str], frequencies: DataFrame, least: int = 5) -> DataFrame:
    """(name, count). A base is dropped when one Han letter comes before it in over half of its places, or
    determiners in over 60 %; the longer name is taken when it makes up 80 %; function letters, titles, common
    words (50 in all, 200 for the given name) and fragments with one Han follower in 80 % are dropped."""
    found = candidates(docs, single, double)
    han = lambda c: F.regexp_like(c, F.lit(f"^[{HAN}]$"))
    found = written(found, "candidates")
    first = F.min(F.struct("first_doc", "first_pos")).alias("first")
    before = found.groupBy("base", "prev").agg(F.sum("n").alias("n"), first)
    bases = before.groupBy("base").agg(F.sum("n").alias("count"), F.max("n").alias("top"), F.min_by("prev", F.struct(-F.col("n"), "first")).alias("top_prev"), F.sum(F.when(F.col("prev").isin(sorted(determiners)), F.col("n")).otherwise(0)).alias("determined"))
    bases = bases.where(F.col("count") >= least).where(~(han(F.col("top_prev")) & (F.col("top") > 0.5 * F.col("count")))).where(F.col("determined") <= 0.6 * F.col("count"))
    longer = found.where("full IS NOT NULL").groupBy("base", "full").agg(F.sum("n").alias("n"), first)
    best = longer.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "first"))).where("k = 1")
    picked = bases.join(best.select("base", "full", "n"), "base", "left")
    extend = F.coalesce(F.col("n") >= 0.8 * F.col("count"), F.lit(False))
    named = picked.select(F.when(extend, F.col("full")).otherwise(F.col("base")).alias("name"), F.when(extend, F.col("n")).otherwise(F.col("count")).alias("count"))
    given = F.when(F.substring("name", 1, 2).isin(sorted(double)), F.expr("substring(name, 3)")).otherwise(F.expr("substring(name, 2)"))
    named = named.withColumn("given", given).where(~F.regexp_like("given", F.lit("[" + "".join(sorted(function)) + "]"))).where(~F.col("given").isin(sorted(titles)))
    known = frequencies.select(F.col("word"), "freq")
    named = named.join(known.select(F.col("word").alias("name"), F.col("freq").alias("f_name")), "name", "left").join(known.select(F.col("word").alias("given"), F.col("freq").alias("f_given")), "given", "left")
    named = named.where(F.coalesce("f_name", F.lit(0)) < 50).where((F.length("given") < 2) | (F.coalesce("f_given", F.lit(0)) < 200))
    named = written(named, "named")
    after = followers(docs, named)
    return named.join(after, "name", "left").where(~F.coalesce(han(F.col("top")) & (F.col("share") >= 0.8), F.lit(False))).select("name", "count")


def readings(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, reading) by the table (letter, reading); a name with an unknown letter has none."""
    letters = names.select("name", F.posexplode(F.split("name", "")).alias("pos", "letter")).where("letter <> ''")
    read = letters.join(table, "letter", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.initcap("reading").alias("r")))).alias("rs"), F.bool_or(F.col("reading").isNull()).alias("gap"))
    return read.where("NOT gap").select("name", F.array_join(F.transform("rs", lambda x: x["r"]), " ").alias("reading"))
