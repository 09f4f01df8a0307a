"""Tables with versions, library folders, files, streams that stop, and batches and ranges of any size."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import html, objects, select, terms
from textloom.functions import lines as ln
from textloom.operators import batching, chapters, intervals, numbering, sync
from textloom.sources import library_source, sidecars
from textloom.sources.versions import Overtaken, VersionedTable, span_key
from textloom.streaming import guarded, marks


@pytest.fixture
def table(spark, tmp_path):
    rows = chapters.conformed(spark.range(60).select(F.concat(F.lit("a/é="), (F.col("id") % 3).cast("string")).alias("project"), F.col("id").alias("idx"), F.lit("text").alias("content")))
    kept = VersionedTable(spark, f"file://{tmp_path}/t", span_key(rows=20))
    assert kept.version() == 0 and kept.replace(rows) == 1
    return kept


def marked(rows):
    return rows.withColumn("status", F.when(F.col("idx") == 5, "error").otherwise(F.col("status")))


def test_edits_rewrite_only_what_they_touch(table):
    before = {tuple(r) for r in table.folders().collect()}
    assert table.edit(marked, table.read().where("idx = 5")) == 2
    after = {tuple(r) for r in table.folders().collect()}
    assert len(before) == len(after) == 9 and len(before & after) == 8
    assert table.read().where("status = 'error'").count() == 1 and table.read(1).where("status = 'error'").count() == 0 and table.read().count() == 60
    assert table.edit(lambda r: r.where("idx >= 20"), table.read().where("idx < 20")) == 3 and table.read().count() == 40 and table.folders().count() == 6


def test_a_stop_before_the_switch_leaves_the_old_version(table, monkeypatch):
    def stopped(base, content):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "switch", stopped)
    with pytest.raises(KeyboardInterrupt):
        table.edit(marked, table.read().where("idx = 5"))
    monkeypatch.undo()
    assert table.version() == 1 and table.read().where("status = 'error'").count() == 0
    assert len(table.unnamed()) == 1  # what was written is part of no version
    assert table.edit(marked, table.read().where("idx = 5")) == 2


def test_of_two_edits_of_one_version_one_is_refused(table):
    assert table.edit(marked, table.read().where("idx = 5"), base=1) == 2
    with pytest.raises(Overtaken):
        table.edit(lambda r: r.withColumn("title", F.lit("x")), table.read().where("idx = 40"), base=1)
    assert table.version() == 2 and table.read().where("title = 'x'").count() == 0


def test_snapshots_are_names(table):
    table.name("first")
    table.edit(marked, table.read().where("idx = 5"))
    assert table.read("first").where("status = 'error'").count() == 0
    with pytest.raises(Overtaken):
        table.name("first")
    table.replace(table.read(2).where("idx = 5"))
    assert table.unnamed(keep=1) != table.unnamed(keep=2) and table.read().count() == 1


def test_rows_for_a_partition_that_was_not_read_are_refused(table):
    with pytest.raises(ValueError, match="did not touch"):
        table.edit(lambda r: r.withColumn("idx", F.col("idx") + 20), table.read().where("idx = 5"))
    assert table.version() == 1


def test_files_do_not_grow_with_the_number_of_partitions(spark, tmp_path):
    rows = chapters.conformed(spark.range(2000).select(F.lit("a").alias("project"), F.col("id").alias("idx"), F.lit("text").alias("content")))
    kept = VersionedTable(spark, f"file://{tmp_path}/t", span_key(rows=1))
    kept.replace(rows)
    assert kept.folders().count() == 2000 and len(list((tmp_path / "t" / "data").rglob("*.parquet"))) <= 8
    kept.edit(marked, rows.where("idx < 1000"))
    assert len(list((tmp_path / "t" / "data").rglob("*.parquet"))) <= 16
    assert kept.read().count() == 2000 and [r["idx"] for r in kept.read().where("status = 'error'").collect()] == [5]


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    kept = VersionedTable(spark, f"file://{tmp_path}/t", F.lit("all"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        kept.replace(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(list((tmp_path / "t" / "data").rglob("*.parquet"))) > 1 and kept.read().count() == 40_000


def test_versions_with_a_folder_for_each_partition_are_still_read(table, spark):
    rows = table.read().withColumn("version_key", table.key)
    rows.write.partitionBy("version_key").parquet(f"{table.root}/data/commit=0ld")
    rows.select("version_key", F.lit("0ld").alias("commit")).distinct().write.parquet(f"{table.root}/manifests/0ld")
    table.switch(1, {"version": 2, "manifest": "manifests/0ld", "schema": rows.drop("version_key").schema.jsonValue(), "note": ""})
    assert table.edit(marked, table.read().where("idx = 5")) == 3
    assert table.read().count() == 60 and table.read().where("status = 'error'").count() == 1
    assert {r["commit"] == "0ld" for r in table.folders().collect()} == {True, False}


def test_a_plan_that_is_shown_is_the_one_that_is_written(spark, tmp_path):
    items = spark.createDataFrame([("a", 5, 1.0), ("b", 6, 1.0)], "relpath string, size long, mtime double")
    manifest = spark.createDataFrame([("a", 5, "1.0", "done")], "relpath string, size long, mtime string, status string")
    plan = sync.plan_uploads(items, manifest).where("send")
    shown = sorted(map(tuple, plan.collect()))
    sidecars.replace_table(plan, f"file://{tmp_path}/plan")
    assert sorted(map(tuple, sidecars.current_table(spark, f"file://{tmp_path}/plan").collect())) == shown == [("b", 6, 1.0, True)]


def test_library_reads_one_projects_files(spark, tmp_path):
    folder = f"file://{tmp_path}/library"
    rows = chapters.conformed(spark.range(40).select(F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("project"), F.col("id").alias("idx")))
    library_source.write_library(rows, folder)
    library_source.register(spark)
    (tmp_path / "library" / "stray").mkdir()
    every = spark.read.format("library").load(folder)
    assert every.count() == 40 and every.columns == list(chapters.SCHEMA)
    for path in (tmp_path / "library" / "p1" / "chapters").iterdir():
        path.write_bytes(b"broken")
    one = spark.read.format("library").load(folder).where("project = 'p0' AND idx BETWEEN 10 AND 20 AND status = 'pending'")
    assert sorted(r["idx"] for r in one.collect()) == [10, 12, 14, 16, 18, 20]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("library").load(folder).count()
    reader = library_source.LibraryReader(str(tmp_path / "library"))
    assert [p.name for p in reader.partitions()] == ["p0", "p1"]


def test_texts_are_written_under_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("a b/ć.srt", "x\r\ny\n"), ("empty", None), ("d%20", "z")], "name string, text string")
    folder = f"file://{tmp_path}/texts"
    assert {r["name"]: r["bytes"] for r in sidecars.write_texts(rows, folder).collect()} == {"a b/ć.srt": 5, "empty": 0, "d%20": 1}
    assert (tmp_path / "texts" / "a b" / "ć.srt").read_bytes() == b"x\r\ny\n"
    assert {r["name"]: r["text"] for r in sidecars.read_texts(spark, folder).collect()} == {"a b/ć.srt": "x\r\ny\n", "empty": "", "d%20": "z"}
    for name in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(Exception, match="not a name"):
            sidecars.write_texts(spark.createDataFrame([(name, "x")], "name string, text string"), folder).collect()


def test_unconfirmed_files_are_told_after_a_restart(spark, tmp_path):
    log, told, seen = (f"{tmp_path}/{n}" for n in ("log", "told", "seen"))
    put = lambda *rows: spark.createDataFrame(rows, marks.LOG).coalesce(1).write.mode("append").parquet(log)
    run = lambda: (marks.follow(spark, log, told, seen).awaitTermination(), {tuple(r) for r in marks.told(spark, told).collect()})[1]
    put(("a", 1, "sending", 5), ("b", 1, "sending", 6), ("b", 2, "done", 6))
    first = run()
    assert first == {("a", 1, "sending", 5, "new"), ("b", 2, "done", 6, "new")}
    put(("c", 3, "done", 1), ("b", 1, "sending", 6))
    second = run()
    assert second - first == {("a", 1, "sending", 5, "unconfirmed"), ("c", 3, "done", 1, "new"), ("b", 2, "done", 6, "again")}
    put(("a", 4, "done", 5))
    assert run() - second == {("a", 4, "done", 5, "changed")}
    states = {r["file"]: (r["status"], r["unconfirmed"]) for r in marks.known_states(marks.told(spark, told)).collect()}
    assert states == {"a": ("done", False), "b": ("done", False), "c": ("done", False)}


def test_a_fatal_error_ends_the_run_and_the_next_goes_on(spark, tmp_path):
    source, sink, seen = (f"{tmp_path}/{n}" for n in ("items", "done", "seen"))
    for k in range(3):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(source)
    tried = spark.sparkContext.accumulator(0)

    def work(fatal):
        def run(batch):
            tried.add(batch.count())
            return batch.select("id", F.when(F.col("id") % 4 == 1, "bad").when(F.col("id") == fatal, "limit reached").otherwise("").alias("error"), (F.col("id") == fatal).alias("fatal"))

        return run

    go = lambda fatal: guarded.guarded(spark, source, "id long", work(fatal), "id", "id", sink, seen).awaitTermination()
    read = lambda part: sorted(tuple(r) for r in spark.read.parquet(f"{sink}/batch=*/{part}").collect())
    with pytest.raises(Exception, match="limit reached"):
        go(7)
    kept = {r[0] for r in read("good")}
    assert 7 not in kept and all(i not in kept for i in (8, 12, 13)) and (7, "limit reached", True) in read("errors")
    before = tried.value
    go(-1)
    assert {r[0] for r in read("good")} == {i for i in range(15) if i % 4 != 1}
    assert [r for r in read("errors") if not r[2]] == [(i, "bad", False) for i in (1, 5, 9, 13)]
    assert tried.value - before < 15


def folded(sizes, most, limit):
    out, files, total, first = [], 0, 0, 0
    for k, size in enumerate(sizes):
        if files >= most or files and total + size > limit:
            out.append((first, files, total))
            first, files, total = k, 0, 0
        files, total = files + 1, total + size
    return [*out, (first, files, total)] if files else out


@pytest.mark.parametrize(("stretch", "part_rows"), [(10_000, 200_000), (32, 50), (7, 11)])
def test_batches_equal_the_fold(spark, stretch, part_rows):
    rnd = random.Random(stretch)
    rows = [(f, i, rnd.choice([None, 0, 1, 5, 9, 50, 200])) for f, n in (("a", 1), ("b", 300), (None, 25), ("c", 64)) for i in range(n)]
    by = {}
    for f, _, s in rows:
        by.setdefault(f, []).append(s or 0)
    got = {}
    for r in batching.batched(spark.createDataFrame(rows, "folder string, i long, size long").repartition(3), ["folder"], ["i"], 7, 60, stretch=stretch, part_rows=part_rows).collect():
        got.setdefault(r["folder"], []).append((r["batch"], r["first"], r["files"], r["bytes"]))
    assert {f: sorted(x) for f, x in got.items()} == {f: [(k, *x) for k, x in enumerate(folded(s, 7, 60))] for f, s in by.items()}


def test_batches_of_nothing(spark):
    assert batching.batched(spark.createDataFrame([], "folder string, i long, size long"), ["folder"], ["i"]).count() == 0


def test_numbers_over_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 4).alias("k"), F.col("id").alias("i"), (F.col("id") % 5).alias("s"))
    got = numbering.numbered(rows, ["k"], ["i"], "s", part_rows=40).collect()
    want = {}
    for k in range(4):
        total = 0
        for pos, i in enumerate(range(k, 300, 4)):
            want[i] = (pos, total)
            total += i % 5
    assert {r["i"]: (r["pos"], r["before"]) for r in got} == want


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-9, 60), st.integers(0, 50)), max_size=8))
@settings(max_examples=5, deadline=None)
def test_points_within_ranges(spark, spans):
    points = [(k, n) for k in (0, 1) for n in range(-12, 120, 3)] * 2
    ranges = spark.createDataFrame([(k, lo, lo + n - 1) for k, lo, n in spans], "k long, lo long, hi long")
    got = intervals.within(spark.createDataFrame(points, "k long, n long"), ranges, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, n in points if any(a == k and lo <= n < lo + w for a, lo, w in spans))


def test_wide_ranges_cost_two_bins(spark):
    ranges = spark.createDataFrame([(0, 1, 10**9), (0, 2 * 10**9, 2 * 10**9 + 5), (1, 3, 3)], "k long, lo long, hi long")
    assert intervals.binned(intervals.merged(ranges, ["k"]), ["k"]).count() <= 6


PAGE = """<html lang=fr><head><meta property="og:title" content=" A &amp; B "><title>T</title><script type="application/ld+json">{"a":"<p>"}</script></head><body><nav><a href=/x>X</a></nav>
<div id=main class="a b"><h1>H <i>1</i></h1><p>one<p>two<br>three <span class=ad>AD</span><ul><li>x<li>y</ul><div><p class=lead>deep</p></div></div>tail</body></html>"""


@pytest.mark.parametrize(("spec", "want"), [
    ("meta[property='og:title'] @content", ["A & B"]), ("title", ["T"]), ("h1", ["H 1"]), ("#main > p", ["one", "two three"]), ("#main p.lead", ["deep"]), ("div.a.b | lines", ["H 1", "one", "two", "three", "x", "y", "deep"]),
    ("script", ['{"a":"<p>"}']), ("li", ["x", "y"]), ("a[href^='/'] @href", ["/x"]), ("HTML @lang", ["fr"]), ("body > nav a, h1", ["X", "H 1"]), ("div[class~=b] > div > *", ["deep"]), ("[lang|=fr] @lang", ["fr"]), ("p > b", []), ("a @title", []),
])
def test_selectors(spec, want):
    assert select.Reader([select.Pick.of(spec)], ".ad").read(PAGE) == [want]


def test_references_end_with_a_semicolon():
    page = '<a href="/?a=1&copy=2&lt;&amp;&ampx&quot">t &quot &lt; &amp</a><script>a&&b&quot;&quot</script><p>'
    assert select.Reader([select.Pick.of(s) for s in ("a @href", "a", "script")]).read(page) == [["/?a=1&copy=2<&&x&quot"], ["t &quot < &"], ["a&&b&quot;&quot"]]
    assert html.read_tightest("<p>&quot &quot; &amp</p>", 1) == '&quot " &'


@pytest.mark.parametrize("bad", ["", "> a", "a >", "a,,b", "a[", "!"])
def test_selectors_that_cannot_be_read(bad):
    with pytest.raises(ValueError):
        select.fields({"x": [bad]})


def test_pages_that_are_broken_or_deep(spark):
    read = lambda page: select.Reader([select.Pick.of("p | lines")]).read(page)[0]
    assert read("<p>a<b>b</p>c</b><p>d") == ["ab", "d"] and read("</p></div><p") == [] and read("<table><tr><td><p>x<tr><td>y") == ["x"]
    assert read("<div>" * 3000 + "<p>deep" + "</div>" * 3000) == ["deep"]
    rows = spark.createDataFrame([(None,), ("",)], "html string").select(select.fields({"t": ["h1", "title"]}, {"l": "a @href"})(F.col("html")).alias("f"))
    assert [(r["f"]["t"], r["f"]["l"]) for r in rows.collect()] == [("", []), ("", [])]


def test_objects_go_to_the_nearest_with_the_keys():
    stream = '1:["$",{"storySlug":"a","x":{"title":"no \\"{"},"chapters":[{"n":1}],"title":"T"}]\n2: stray " quote {"storySlug":"b" {\n3:{"storySlug":"a","title":2}'
    found = [x["title"] for _, x in objects.read_objects(stream, '"storySlug":"a"', ("title",))]
    assert found == ["T", 2]
    assert not list(objects.read_objects(stream, "", ("title",))) and not list(objects.read_objects("", "a", ("title",)))
    deep = '{"a":' * 20_000 + "1" + "}" * 20_000
    assert not list(objects.read_objects(deep, '"a"', ("b",)))


@given(st.recursive(st.one_of(st.integers(), st.text(max_size=5), st.booleans(), st.none()), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["id", "t", "x", "{"]), x, max_size=3)), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_objects_of_any_json(value):
    """Each needle goes to the innermost object around it that has the key, as a walk through the value finds."""
    want = []

    def walk(v):
        if isinstance(v, dict):
            for x in v.values():
                walk(x)
            if "id" in v and not any(v is w for w in want):
                want.append(v)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(value)
    assert [x for _, x in objects.read_objects("1:" + json.dumps(value), '"id":', ("id",))] == want


def test_gates_come_before_the_text(spark):
    body = "<article><p>T</p><p>" + "x" * 500 + "</p></article>"
    label = lambda page: spark.range(1).select(html.chapter_page(F.lit(page), F.lit("T"))).first()[0]
    assert tuple(label(body)) == ("open", ["x" * 500])
    assert tuple(label('<div data-preview-gate></div><script>{"isLocked":true}</script>' + body)) == ("preview", None)
    assert tuple(label('<script>{"isLocked":true}</script>' + body)) == ("locked", None)
    assert tuple(label('<script>{"isRateLimited":true}</script>' + body)) == ("open", ["x" * 500])
    assert [label(p)[0] for p in ("<article><p>T</article>GIỚI HẠN ĐỌC TRONG NGÀY", "Bạn đọc quá nhanh", "<p>x", "<article></article>")] == ["daily", "rate", "missing", "empty"]


def test_terms():
    rnd = random.Random(2)
    for k in range(600):
        words = list(dict.fromkeys("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 7))))
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(40)))
        assert sorted(terms.Automaton(words).places(text)) == sorted((i + len(t), n) for n, t in enumerate(words) for i in range(len(text)) if text.startswith(t, i))
        pairs, want = {t: rnd.choice(["X", "YZ", "Q "] if k % 2 else ["a", "", "bc"]) for t in words}, text
        for t, v in sorted(pairs.items(), key=lambda kv: -len(kv[0])):
            want = want.replace(t, v)
        assert terms.Glossary(pairs).apply(text) == want


def test_backfill_refuses_to_guess(spark):
    log = lambda *times: "".join(f"silence_start: {a}\nSilence_End: {b} | x\n" for a, b in times)
    made = lambda chunks, logs, length=9.0: spark.range(1).select(ln.backfilled(F.array(*map(F.lit, chunks)).cast("array<string>"), F.array(*map(F.lit, logs)).cast("array<string>"), F.lit(length))).first()[0]
    two = log((1.0, 1.5))
    assert [tuple(c) for c in made(["a", "b"], [log(), two, log((3, 4))])] == [(0.0, 1.0, "a"), (1.5, 9.0, "b")]
    assert [tuple(c) for c in made(["a"], [])] == [(0.0, 9.0, "a")]
    assert made(["a", "b"], [log(), log((1, 2), (3, 4))]) is None and made([], [two]) is None and made(["a", "b"], [two], 0.0) is None
    assert [tuple(c) for c in made(["a", "b"], [log((-1, 2))])] == [(0.0, 0.0, "a"), (2.0, 9.0, "b")]


def test_packing_takes_time_in_proportion(spark):
    """A long text is cut as by hand, and four times the text does not take sixteen times the time."""
    import time

    from textloom.functions import text as tx

    took = []
    for n in (40_000, 160_000):
        text = "The river ran on past the mill. It was late!  Who knew? " * n
        rows = spark.createDataFrame([(text,)], "text string").cache()
        rows.count()
        began = time.perf_counter()
        got = rows.select(tx.sentence_chunks(F.col("text"), 400).alias("c")).first()["c"]
        took.append(time.perf_counter() - began)
        words = [s.strip() for s in ("The river ran on past the mill.", "It was late!", "Who knew?")] * n
        assert got == tx.pack_pieces(words, 400, " ") and max(map(len, got)) <= 400 and " ".join(got) == " ".join(words)
    assert took[1] < 10 * took[0] + 5
