"""Every registered query of the library's own operators against DuckDB, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from textloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = rows(df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert mine
        return
    theirs = duck.sql(registry.ORACLES[name])
    assert sorted(theirs.columns) == columns
    assert mine == rows(theirs.select(*(f'"{c}"' for c in columns)).fetchall())


#: Titles as pages have them: cut after so many characters, within a reference too.
CUT = [f"{words} &{name};"[:n] for words in ("A b", "R&amp;D &amp;c") for name in ("amp", "quot") for n in range(len(words), len(words) + len(name) + 4)]


@pytest.mark.parametrize("name", ["page_paragraphs", "page_fields", "page_lines"])
def test_pages_with_cut_titles(spark, tmp_path, name):
    page = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title><script>var t="</p>&quot";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b&amp;c">b&amp;c</a></li></ul></nav><div class="ad">ad &quot;x&quot;</div><article><h1>{0}</h1><p><b>{0}</b> &amp;quot; more<br>two<p>last &quot;</article></body></html>'
    pages = [(3 * i + k, "https://a.example/", page.format(title)) for i, title in enumerate(CUT) for k in range(3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df, theirs = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert rows(df.select(*columns).collect()) == rows(theirs.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry_imports_without_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
