from collections import Counter
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from spatialplate.llm import line_dedup
from spatialplate.llm.queries import QUERIES, SQL

from ..oracle import duck_rows, spark_rows


def plain(rows, percent, least):
    pages, seen = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        seen.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ") and text is not None})
    bad = {k for k, n in seen.items() if n >= least and n * 100 > percent * pages[k[0]]}
    return [None if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(" ")) not in bad) for host, text in rows]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST", broadcast)
    rows = [("h", f"menu\nline {i}\n\n  menu \nonce") if i % 2 else ("h", f"line {i}\nfooter") for i in range(20)]
    rows += [(None, "menu\nx"), (None, "menu\ny"), ("g", None), ("g", ""), ("k", "same"), ("k", "same"), ("k", "same"), ("k", "same"), ("k", "x\n" * 50_000)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "id int, source string, text string").selectExpr("*", "1 AS host", "2 AS lines", "3 AS _n")
    out = line_dedup.drop_boilerplate(df, percent=30, least=3).orderBy("id").collect()
    assert [r.text for r in out] == plain(rows, 30, 3)
    assert out[1]._lines == 5 and out[1]._dropped == 3 and out[22]._lines == 0 and out[23]._lines == 1 and out[24].text == "" and out[20].text == "menu\nx"
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0


def test_no_python_runs(spark, sf):
    plan = QUERIES["op8_site_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_matches_sql(spark, sf):
    assert spark_rows(QUERIES["op8_site_lines"](spark, sf)) == duck_rows(SQL["op8_site_lines"], sf)


def test_pages_by_the_host_of_their_address(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", line_dedup.host_of(F.col("url")))
    rows = pages.select("page_id", "url", "host", "html").orderBy("page_id").collect()
    for r in rows:
        host = urlsplit(r.url).hostname if r.url else None
        assert r.host == (host.removeprefix("www.") if host else None)
    out = line_dedup.drop_boilerplate(pages, "host", "html", 20, 3).orderBy("page_id").collect()
    assert [r.html for r in out] == plain([(r.host, r.html) for r in rows], 20, 3)
    odd = spark.createDataFrame([("https://WWW.Example.org:80/a?b",), (None,), ("no address",), ("",)], "url string")
    assert [r[0] for r in odd.select(line_dedup.host_of(F.col("url"))).collect()] == ["example.org", None, None, None]
