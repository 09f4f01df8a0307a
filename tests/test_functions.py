"""Golden cases of text, timeline, sync and extraction operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import html, timeline
from textloom.functions import text as tx
from textloom.operators import chapters, names, sync
from textloom.sources import sidecars


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Trời mưa 🌧🌂 suốt đêm", "Trời mưa suốt đêm"), ("〔Quyển 3〕◆ Gió nổi", "Quyển 3 Gió nổi"), ("x♦y", "x y"), ("Một ― hai ‒ ba", "Một - hai - ba"), ("Đi？ về！ 「ừ」", 'Đi? về! "ừ"'), ("Xa.\n\n《…》!\n\nGần.", "Xa.\n\nGần."), ("Ngày.\n\n\n\n\nĐêm.", "Ngày.\n\nĐêm."), ("th\u200dư", "thư"), ("", "")],
)
def test_clean(spark, text, expected):
    assert one(spark, tx.clean(F.col("t")), t=text) == expected
    assert one(spark, tx.clean(F.col("t")), t=expected) == expected


def test_clean_extra(spark):
    assert one(spark, tx.clean(F.col("t"), "!"), t="Mau lên！") == "Mau lên"


def test_paragraph_chunks(spark):
    assert one(spark, tx.paragraph_chunks(F.col("t"), 10), t="aaaa\n\nbbbb\n\ncccc") == ["aaaa\n\nbbbb", "cccc"]
    assert one(spark, tx.paragraph_chunks(F.col("t"), 10), t="x" * 50) == ["x" * 50]
    assert one(spark, tx.paragraph_chunks(F.col("t"), 10), t="") == []


def test_paragraph_chunks_keep_indents(spark):
    assert one(spark, tx.paragraph_chunks(F.col("t"), 12), t="  one\n\n \n\ntwo \n\nthree") == ["  one\n\ntwo ", "three"]


def test_sentence_chunks(spark):
    text = "Câu một dài dài. Câu hai dài dài. Câu ba dài dài."
    assert len(one(spark, tx.sentence_chunks(F.col("t"), 35), t=text)) == 2
    assert one(spark, tx.sentence_chunks(F.col("t"), 100), t="Đoạn một.\n\nĐoạn hai.") == ["Đoạn một.", "Đoạn hai."]


def test_merge_short(spark):
    merge = lambda xs: one(spark, tx.merge_short(F.array(*map(F.lit, xs)), 30, 400))
    assert merge(["A.", "B.", "C.", "D."]) == ["A. B. C. D."]
    assert merge(["Đi.", "x" * 399]) == ["Đi.", "x" * 399]


def test_literal_replace(spark):
    assert one(spark, tx.literal_replace(F.col("t"), "mưa", "nắng"), t="mưa rồi lại mưa") == "nắng rồi lại nắng"
    assert one(spark, tx.literal_replace(F.col("t"), "CAT", "$1\\", True), t="a cat") == "a $1\\"
    assert one(spark, tx.literal_count(F.col("t"), ""), t="abc") == 0


@pytest.mark.parametrize(("name", "slug"), [("  One River, Two Banks?", "one-river-two-banks"), ("山水之间", "novel"), ("山水 Part 7", "part-7"), ("Đường Về Phía Biển", "duong-ve-phia-bien"), ("Ｒoad ４５ ﬂat ǆ", "road-45-flat-dz"), ("№ Ⅷ", "no-viii")])
def test_slug(spark, name, slug):
    assert one(spark, tx.slug(F.col("t")), t=name) == slug


@pytest.mark.parametrize(("name", "folder"), [("Sông: hồ?", "Sông hồ"), ("Mưa rào . .", "Mưa rào"), ("Lpt3", "_Lpt3"), ("<|>", "novel")])
def test_safe_name(spark, name, folder):
    assert one(spark, tx.safe_name(F.col("t")), t=name) == folder


@pytest.mark.parametrize(("text", "size"), [("2.048 bytes", 2048), ("1,5 KB", 1536), ("0,25 GB", 268435456), ("7 MBit", None), ("12 tệp", None)])
def test_parse_size(spark, text, size):
    assert one(spark, tx.parse_size(F.col("t")), t=text) == size


def test_tags(spark):
    tags = lambda raw, n=500: one(spark, tx.tags(F.col("t"), n), t=raw)
    assert tags("Gió,gió\nGIÓ, mây") == ["Gió", "mây"]
    assert tags("one, six", 8) == ["one", "six"] and tags("one, six", 7) == ["one"]  # the second costs 2 more
    assert tags("a b, x", 5) == ["a b"] and tags("a b, x", 8) == ["a b", "x"]  # a space costs 2
    assert tags("much too long, tag", 6) == ["tag"]  # skipped
    assert tags("aaa, bbbb, c", 8) == ["aaa"]  # stops, though c would fit
    assert tags("- 'one', 2) ##two, * three  four") == ["one", "two", "three four"]


def test_numbered_title(spark):
    title = lambda t: one(spark, tx.numbered_title(F.lit(11), F.lit(t)))
    assert title("Gió lớn") == "Chương 12: Gió lớn" and title("Chươngmưa") == "Chương 12: Chươngmưa"
    assert all(title(t) == t for t in ("chuong 3 x", " CHAPTER 9", "第二十章 x", "Chưong 4", "Chuơng 4"))


def test_glossary(spark):
    assert one(spark, tx.glossary(F.lit("林城安在林城。"), {"林城": "Lâm Thành", "林城安": "Lâm Thành An"})) == "Lâm Thành An在Lâm Thành。"


def test_file_names(spark):
    assert one(spark, tx.file_number(F.lit("0041-chuong-41.mp3"))) == 41
    assert one(spark, tx.file_number(F.lit("chuong.mp3"))) is None
    assert tuple(one(spark, tx.part_range(F.lit("truyen-0060-0041")))) == (41, 60)
    assert one(spark, tx.part_range(F.lit("truyen"))) is None


@pytest.mark.parametrize(("s", "text"), [(1.5, "00:00:01,500"), (61.007, "00:01:01,007"), (3 * 3600 + 36 * 60 + 39.25, "03:36:39,250"), (-2.0, "00:00:00,000")])
def test_srt_time(spark, s, text):
    assert one(spark, timeline.srt_time(F.lit(s))) == text


def test_other_times(spark):
    assert [one(spark, timeline.ass_time(F.lit(s))) for s in (20.5, 3725.5)] == ["0:00:20.50", "1:02:05.50"]
    assert [one(spark, timeline.short_time(F.lit(s))) for s in (65.0, 125.4, 3725.0)] == ["1:05", "2:05", "1:02:05"]
    assert [one(spark, timeline.part_number(F.lit(n), b)) for n, b in ((1381, 20), (661, 20), (500, 0))] == [70, 34, 1]


def test_grid_windows_ignore_gaps(spark):
    rows = spark.createDataFrame([("p", i) for i in range(25) if i != 4], "project string, idx long")
    got = timeline.grid_windows(rows, ["project"], 10).orderBy("part").collect()
    assert [(r["first"], r["last"], r["size"]) for r in got] == [(1, 10, 9), (11, 20, 10), (21, 25, 5)]


def test_offsets_and_srt(spark):
    rows = spark.createDataFrame([("p", 0, 12000), ("p", 1, 8500)], "k string, i int, ms long")
    assert [(r["start_ms"], r["end_ms"]) for r in timeline.offsets(rows, ["k"], ["i"]).orderBy("i").collect()] == [(0, 12000), (12000, 20500)]
    cues = spark.createDataFrame([("p", 0, 0.0, 1.0, "Một"), ("p", 1, 1.0, 2.0, "   "), ("p", 2, 2.0, 3.0, "Ba")], "k string, i int, start double, `end` double, text string")
    doc = timeline.srt_documents(cues, ["k"], ["i"]).first()
    assert doc["cues"] == 2 and doc["document"].startswith("1\n00:00:00,000 --> 00:00:01,000\nMột\n\n2\n")


def test_sync_plan(spark):
    items = spark.createDataFrame([(k, 10, m) for k, m in (("a", 1000.0), ("b", 1001.0), ("c", 9000.0), ("d", 1000.0), ("e", 1000.0), ("f", 1000.0), ("g", 1.0))], "relpath string, size long, mtime double")
    manifest = spark.createDataFrame([("a", 10, "1000", "done"), ("b", 10, "1000", "done"), ("c", 10, "1000", "done"), ("d", 99, "1000", "done"), ("e", 10, "1000", "sending"), ("f", 10, "x", "done")], "relpath string, size long, mtime string, status string")
    got = {r["relpath"]: r["send"] for r in sync.plan_uploads(items, manifest).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": True, "e": True, "f": True, "g": True}


@pytest.mark.parametrize(
    ("sizes", "bounds", "expected"), [([1] * 45, (20, 10**9), [20, 20, 5]), ([400] * 5, (20, 1000), [2, 2, 1]), ([6 << 30, 10], (20, 4 << 30), [1, 1])]
)
def test_batches(spark, sizes, bounds, expected):
    items = spark.createDataFrame([("f", i, s) for i, s in enumerate(sizes)], "folder string, i int, size long")
    assert [r["files"] for r in sync.batches(items, ["folder"], ["i"], *bounds).orderBy("batch").collect()] == expected


def test_delete_sizes(spark):
    safe = lambda a, b: one(spark, sync.safe_to_delete(F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert [safe(419430400, 419928664), safe(419430400, 398000000), safe(5, None), safe(0, 0)] == [True, False, False, False]


def test_upload_state(spark):
    raw = ['{"status": "published"}', "", None, "{broken", "{}"]
    assert [one(spark, sync.upload_state(F.lit(x).cast("string"))) for x in raw] == ["published", "", "", "unknown", ""]


def test_chapter_lifecycle(spark):
    rows = chapters.conformed(spark.createDataFrame([("p", i, f"t{i}", f"u{i}") for i in range(5)], "project string, idx long, title string, url string"))
    saved = chapters.save_content(rows, spark.createDataFrame([("p", 0, "x"), ("p", 2, "y")], "project string, idx long, content string"))
    assert [r["idx"] for r in chapters.pending_download(saved).orderBy("idx").collect()] == [1, 3, 4]
    assert [r["idx"] for r in chapters.pending_download(saved, 1, 3).orderBy("idx").collect()] == [1, 3]
    again = chapters.replace_toc(saved, spark.createDataFrame([("p", i, f"n{i}", f"v{i}") for i in range(6)], "project string, idx long, title string, url string"), "now")
    got = {r["idx"]: r for r in again.collect()}
    assert len(got) == 6 and got[0]["content"] == "x" and got[0]["title"] == "n0" and got[5]["title_source"] == "" and got[5]["status"] == "pending"
    done = chapters.save_translation(saved, spark.createDataFrame([("p", 0, "z", "vi")], "project string, idx long, translated string, target_lang string"))
    assert [r["idx"] for r in chapters.pending_translation(done, "vi").collect()] == [2]
    assert sorted(r["idx"] for r in chapters.pending_translation(done, "en").collect()) == [0, 2]
    renamed = chapters.edit_title(rows, spark.createDataFrame([("p", 1, "mine")], "project string, idx long, title string"))
    kept = {r["idx"]: r["title"] for r in chapters.replace_toc(renamed, rows.select("project", "idx", F.lit("other").alias("title"), "url"), "now").collect()}
    assert kept[1] == "mine" and kept[0] == "other"
    with pytest.raises(ValueError):
        chapters.find(rows, "x", fields=("status",))


def test_find_and_apply(spark):
    rows = chapters.conformed(spark.createDataFrame([("p", 0, "a cat and a cat", "cat"), ("p", 1, "none", "")], "project string, idx long, title string, content string"))
    found = chapters.find(rows, "cat", new="dog")
    assert [(c["field"], c["n"]) for c in found.first()["changes"]] == [("title", 2), ("content", 1)]
    assert {r["idx"]: r["title"] for r in chapters.apply_changes(rows, found).collect()} == {0: "a dog and a dog", 1: "none"}


def test_append(spark):
    rows = chapters.conformed(spark.createDataFrame([("p", 7)], "project string, idx long"))
    new = chapters.append_rows(rows, spark.createDataFrame([("p", 0, "a"), ("p", 1, "  "), ("p", 2, "b"), ("q", 0, "c")], "project string, pos int, title string"))
    assert sorted((r["project"], r["idx"], r["title"]) for r in new.collect()) == [("p", 8, "a"), ("p", 9, "b"), ("q", 0, "c")]


def test_html(spark):
    page = '<html><head><script>var t="</p>";</script></head><body><nav>skip</nav><article><h1>T &amp; x</h1><p>One<br>two<p>Three</article><p>out</body>'
    assert html.read_paragraphs(page) == ["T & x", "One", "two", "Three"]
    assert one(spark, html.element(F.lit(page), "h1")) == "T & x"
    assert [tuple(x) for x in one(spark, html.anchors(F.lit('<a href="/a?x=1&amp;y=2"><b>A</b></a>')))] == [("/a?x=1&y=2", "A")]
    assert one(spark, html.meta(F.lit('<meta content="v" property="og:title">'), "og:title")) == "v"


def test_references_end_with_a_semicolon():
    page = "<article><p>a &quot &quot; &lt &lt; &amp &ampx &amp;quot &amp;amp; &#39 &#39; &#x27 &#x27; &copy2 &notit; &a &; & &é; &"
    assert html.read_paragraphs(page) == ["a &quot \" &lt < & &x &quot &amp; &#39 ' &#x27 ' &copy2 &notit; &a &; & &é; &"]


def test_cues_and_manifest(spark):
    raw = spark.createDataFrame([("a", '{"version":1,"seconds":3,"cues":[[0,1,"ok"],["bad"],[1,2,"fine"]]}'), ("b", "{"), ("c", None)], "key string, json string")
    assert [r["text"] for r in sidecars.parsed_cues(raw).orderBy("start").collect()] == ["ok", "fine"]
    raw = spark.createDataFrame([("a", '{"files":{"x":{"size":1,"mtime":"2","status":"done"},"y":null}}'), ("b", "["), ("c", None)], "key string, json string")
    assert [(r["relpath"], r["size"]) for r in sidecars.parsed_manifest(raw).collect()] == [("x", 1)]


def test_listing(spark, tmp_path):
    for name in ("a/b.mp3", "a/.hidden", "x.tmp", "db-wal", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = {r["relpath"]: r["size"] for r in sidecars.listing(spark, str(tmp_path)).collect()}
    assert got == {"a/b.mp3": 5, "c.txt": 5}


def test_names(spark):
    lines = ["他看見江妤笑", "是江妤來了", "和江妤走", "對江妤說", "讓江妤坐", "給江妤水", "一張臉紅", "那張臉白", "這張臉大", "半張臉小", "每張臉好"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    freq = spark.createDataFrame([("安全", 900)], "word string, freq long")
    got = names.mine(docs, {"江", "張", "安"}, {"歐陽"}, set("一那這半每"), set("的了"), {"家"}, freq)
    assert {r["name"]: r["count"] for r in got.collect()} == {"江妤": 6}
    table = spark.createDataFrame([("江", "giang"), ("妤", "dư")], "letter string, reading string")
    assert names.readings(got, table).first()["reading"] == "Giang Dư"


def test_resume(spark, tmp_path):
    from textloom.streaming.resume import resume

    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for turn in range(2):
        spark.range(turn * 10, turn * 10 + 10).selectExpr("id AS idx", "'' AS content").coalesce(1).write.mode("append").parquet(source)
        resume(spark, source, "idx long, content string", lambda d: d.where("content = ''"), sink, check).awaitTermination()
        assert spark.read.parquet(sink).count() == 10 * (turn + 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!\n", max_size=40), min_size=1, max_size=6), st.integers(5, 30))
def test_chunks_lose_nothing(spark, texts, limit):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.paragraph_chunks(F.col("text"), limit, "\n").alias("c")).collect()
    for r in rows:
        assert "\n".join(r["c"]).split("\n") == ([p for p in r["text"].split("\n") if p.strip()] or [""])
        assert all(len(x) <= limit or "\n" not in x for x in r["c"])


def test_python_functions_answer_a_large_batch_in_slices(spark):
    import pyarrow as pa

    from textloom.functions import objects, select, slices, terms

    rows = [None, *("<p>" + "x" * 500_000 + "</p>" for _ in range(9))]
    texts, lists = pa.array(rows), pa.array([None if r is None else [r, "y"] for r in rows])
    made = [(html.pushed_stream, texts), (html.tightest_block, texts), (terms.glossary({"a": "b"}), texts), (select.fields({}, {"p": "p"}), texts), (tx.over_lists(list), lists)]
    for run, batch in made:
        sizes = [len(part) for part in run.func(iter([batch, batch.slice(7)]))]
        assert sum(sizes) == 13 and max(sizes) <= 5
    assert list(slices.spans(pa.array([], pa.string()))) == [(0, 0)] and list(slices.spans(pa.array(["a" * 99, "b", None, "c"]), 30)) == [(0, 1), (1, 3)]
    assert list(slices.spans(lists.slice(8), 1)) == [(0, 1), (1, 1)]


def test_counts_are_sent_on_before_they_are_many(spark, monkeypatch):
    from textloom.functions import slices, terms

    docs = spark.range(0, 40, 1, 2).select(F.col("id").alias("doc_id"), F.lit("米江水\n火米江水").alias("text"))
    count = lambda: (sorted(map(tuple, names.candidates(docs, {"米"}, set()).collect()), key=repr), sorted(map(tuple, terms.term_places(docs, ["米江"]).collect())))
    whole = count()
    for module in (names, terms):
        monkeypatch.setattr(module, "HELD", 1)
    monkeypatch.setattr(slices.spans, "__defaults__", (1,))
    assert count() == whole and sum(r[3] for r in whole[0]) == sum(r[3] for r in whole[1]) == 80


def test_stated_tables_are_read_without_python_workers(spark):
    from textloom.plans import mining

    plan = mining.name_readings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_a_glossary_holds_no_places_of_a_whole_text():
    import tracemalloc

    from textloom.functions import terms

    pairs = {"aba": "<1>", "ab": "<2>", "bb": "<3>", "]": "<4>", "ca": "<5>", "n": "<6>"}
    own = terms.Glossary(pairs)
    for text in ("abab cab]bbb ban\n", "ababcab]bbbban"):
        whole, wanted = text * 20_000, text * 20_000
        for k, v in sorted(pairs.items(), key=lambda kv: -len(kv[0])):
            wanted = wanted.replace(k, v)
        tracemalloc.start()
        made = own.apply(whole)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == wanted
        assert peak < 25 * len(whole)
    assert terms.Glossary({}).apply("a") == terms.Glossary({"": "b"}).apply("a") == "a" and terms.Glossary({"ab": "a", "ac": "c"}).apply("abc") == "c"
