"""Guards, side tables and page blocks: what the registered queries cannot show."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import html, timeline
from textloom.operators import chapters, library, sync
from textloom.sources import scratch, sidecars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("name", ["", "  ", "..", "a/b", "a\\b"])
def test_projects_outside_are_refused(spark, name):
    with pytest.raises(ValueError):
        library.without_project(spark.createDataFrame([("a",)], "project string"), name)


def test_merge_windows(spark):
    rows = spark.createDataFrame([("p", i) for i in (0, 1, 24, 25, 29)], "project string, idx long")
    made = lambda *a, **k: sorted(tuple(r)[2:] for r in timeline.merge_windows(rows, ["project"], *a, **k).collect())
    assert made("batch", batch=5) == [(1, 2, 2), (25, 25, 1), (26, 30, 2)]
    assert made("range", start=2, end=25) == [(2, 25, 2)] and made("range", start=3, end=4) == [] and made() == [(1, 30, 5)]
    for mode, batch in (("batch", 0), ("batch", None), ("other", 1)):
        with pytest.raises(ValueError):
            timeline.merge_windows(rows, ["project"], mode, batch=batch)


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        sidecars.replace_table(spark.range(n), path)
        assert sidecars.current_table(spark, path).count() == n
    sidecars.snapshot(spark, path, "five")
    sidecars.replace_table(spark.range(1), path)
    assert sidecars.current_table(spark, path, "five").count() == 5 and sidecars.current_table(spark, path).count() == 1
    with pytest.raises(Exception, match="(?i)there already"):
        sidecars.snapshot(spark, path, "five")


def test_scratch(spark):
    path = scratch.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    scratch.remove(spark, path)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(path)


def test_manifest_notes(spark):
    raw = spark.createDataFrame([("a", None), ("b", "{no"), ("c", '{"files": {}}'), ("d", '{"files": []}')], "key string, json string")
    assert {r["key"]: r["note"] for r in sidecars.manifest_notes(raw).collect()} == {"a": "missing", "b": "corrupt", "c": "", "d": "corrupt"}


def test_landed_ignores_case_and_blanks(spark):
    want = spark.createDataFrame([("A.mp4", 1000), ("b.mp4", 1000), ("c.mp4", 0)], "name string, size long")
    there = spark.createDataFrame([(" a.MP4 ", 1100), ("B.mp4", 500), ("c.mp4", None)], "name string, size long")
    assert [r["name"] for r in sync.landed(want, there).collect()] == ["b.mp4"]


def test_retention_ignores_case(spark):
    audio = spark.createDataFrame([("p", "0002-x.MP3", 1)], "project string, name string, size long")
    parts = spark.createDataFrame([("p", "n-0001-0003", "v.mp4")], "project string, folder string, name string")
    assert sync.retention_plan(audio, parts).count() == 1


def test_tightest_block(spark):
    prose, chrome = "word " * 100, "menu " * 300
    page = f"<nav><div>{chrome}</div></nav><div>top<div><section><p>{prose}</p><p>short</p></section></div></div><footer><p>{chrome}</p></footer>"
    assert one(spark, html.tightest_block(F.lit(page))) == prose.strip()
    assert one(spark, html.tightest_block(F.lit("<p>short</p>"))) == "" == one(spark, html.tightest_block(F.lit("")))


def test_own_story_is_never_another(spark):
    story = lambda **x: F.create_map(*(F.lit(v) for kv in x.items() for v in kv))
    objects = F.array(story(storySlug="b", slug="a", title="by slug"), story(storySlug="a", slug="z", title="own"))
    assert one(spark, html.own_story(objects, F.lit("a")))["title"] == "own"
    assert one(spark, html.own_story(objects, F.lit("q"))) is None


def test_charset(spark):
    read = lambda raw, declared: one(spark, html.decoded(F.lit(bytearray(raw)), F.lit(declared)))
    assert read("第一章".encode(), "UTF-8") == "第一章" == read("第一章".encode("gbk"), "utf-8") == read("第一章".encode("gbk"), "gb2312")


def test_replaced_equals_found_and_applied(spark):
    rows = chapters.conformed(spark.createDataFrame([("p", 0, "A the", "the end"), ("p", 1, "B", "none")], "project string, idx long, title string, content string"))
    two = chapters.apply_changes(rows, chapters.find(rows, "the", new="$1"))
    assert sorted(map(tuple, chapters.replaced(rows, "the", "$1").collect())) == sorted(map(tuple, two.select(*rows.columns).collect()))
