"""URL filters: rules, aliases by links and redirects, odd rows; the same rows as the SQL twin."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filters as U

BAD, GOOD, PLAIN = "https://a.example.com/de/1", "http://b.com/fr/9", "http://c.net/x"


def page(i, url, *tags):
    return (i, url, "<html><head>" + "".join(tags) + "</head><p>t</p></html>")


def canonical(href, q='"'):
    return f"<link rel={q}canonical{q} href={q}{href}{q}>"


def refresh(url):
    return f'<META HTTP-EQUIV="Refresh" content="0; URL={url}">'


PAGES = [
    page(1, PLAIN, canonical(BAD)),
    page(2, "http://d.net/y?q=1", refresh("https://c.net/x#part")),
    page(3, GOOD, canonical(BAD)),
    page(4, BAD),
    page(5, "http://e.net/", "<!-- " + canonical(BAD) + " -->", "<script>var x = '" + canonical(BAD) + "'</script>"),
    page(6, "http://f.net/a/b", canonical("c")),
    page(7, "http://f.net/a/c", canonical("//a.example.com/de/7", "'")),
    page(8, "http://g.net/a/b", canonical("/de/1")),
    page(9, "HTTPS://X.Example.ORG/es/4?x=http://z"),
    page(10, "http://example.org/en/19"),
    page(11, "http://example.org/en/2"),
    page(12, "http://notexample.org.evil/es/"),
    page(13, None, canonical(BAD)),
    page(14, "no scheme"),
    (15, "http://h.net", None),
    page(16, "http://h.net?", canonical("mailto:x@y"), canonical("#top"), canonical("")),
    page(17, "http://i.net/p", "<link data-href='x' rel='next canonical' href=http://c.net/x>"),
    page(17, "http://i.net/p", "<link data-href='x' rel='next canonical' href=http://c.net/x>"),
    page(18, "http://com/de/"),
    page(19, "http://a.com"),
    (None, "http://j.net/r?a=1&b=2", None),
    page(20, "http://k.net/", canonical("http://j.net/r?a=1&amp;b=2"), refresh("http://c.net/x")),
]
EXPECTED = {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "block", 18: "block", 19: "allow", None: "block", 20: "block"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    df.withColumns({"a": F.lit(1), "component": F.lit("x"), "verdict": F.lit("y"), "address": F.lit("z")}).write.parquet(f"{d}/pages.parquet")
    return str(d)


def twin(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({U.ORACLE})").fetchall()


def test_aliases(spark, folder):
    rows = U.op11_url_filters(spark, folder).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id: r.verdict for r in rows} == EXPECTED
    by = {r.page_id: r for r in rows}
    assert (by[9].host, by[9].path, by[9].rule) == ("x.example.org", "/es/4", "example.org/es/")
    assert (by[10].rule, by[11].rule, by[12].rule, by[18].rule, by[19].rule) == ("example.org/en/1", "org/", None, "com/de/", None)
    assert (by[13].host, by[13].path, by[14].host) == ("", "", "")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, twin(folder)))


def test_redirect_table_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://s.net/1", None), (2, "http://t.net/2", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://s.net/1", "http://u.net/"), ("http://u.net", BAD), (None, BAD), (BAD, None)], "source string, target string")
    assert {r.page_id: r.verdict for r in U.judge(pages, U.RULES, moves).collect()} == {1: "block", 2: "allow"}
    tie = (("block", "net", "/12"), ("allow", "s.net", "/"))
    assert U.judge(pages.where("page_id = 1"), tie).first().verdict == "allow"
    assert {r.verdict for r in U.judge(pages, ()).collect()} == {"allow"}
    assert U.judge(pages.limit(0), U.RULES).count() == 0


def test_hub(spark):
    """Very many pages that link to one address, in a chain of hubs."""
    n = 3000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"), F.lit(canonical("http://hub.net/")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([page(n, "http://hub.net/", refresh(BAD))], pages.schema))
    out = U.judge(pages, U.RULES)
    assert out.where("verdict = 'block'").count() == n + 1


def test_python_stays_out(spark, folder):
    plan = U.op11_url_filters(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
