import hashlib
import random
import re

from pyspark.sql import functions as F

from spatialplate.llm import fill_middle
from spatialplate.llm.queries import QUERIES, SQL

from ..oracle import duck_rows, spark_rows


def plain(id_, text):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_against_plain_version(spark):
    rng = random.Random(5)
    pieces = ["a", "é", "語", "😀", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", " ", "\x00", "<", ">", "<P", "S>", "\x1c", "word"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    rows += [(601, None), (602, ""), (None, "a b c d"), (None, None), (603, " \n "), (604, "x <M> y"), (605, "one"), (3, "again a b"), (3, "again a b"), (606, "w " * 200_000), (607, "l" * 1_000_000)]
    df = spark.createDataFrame([(i, t, 1, "own", 2, {"k": 1}) for i, t in rows], "doc_id long, text string, n int, form string, r int, `odd name` map<string,int>")
    out = fill_middle.transformed(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out) == sorted(str((i, t, *plain(i, t))) for i, t in rows)
    assert all(r.back == (r.text or "") for r in out) and {r.form for r in out} == {"plain", "psm", "spm"} and out[0]["odd name"] == {"k": 1}
    assert fill_middle.transformed(df.where("false")).count() == 0


def test_broken_bytes_are_replaced(spark):
    df = spark.sql("SELECT id AS doc_id, cast(X'61FF2062' AS string) AS text FROM range(40)")
    assert {(r.n, r.back) for r in fill_middle.transformed(df).select("n", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()} == {(2, "a� b")}


def test_shares_of_the_forms(spark):
    df = spark.range(4_000).selectExpr("id AS doc_id", "'a b c d e f' AS text")
    n = {r.form: r["count"] for r in fill_middle.transformed(df, rate=90, suffix_first=30).groupBy("form").count().collect()}
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 1_080) < 120 and abs(n["psm"] - 2_520) < 150


def test_query_matches_sql(spark, sf):
    assert spark_rows(QUERIES["op12_fill_middle"](spark, sf)) == duck_rows(SQL["op12_fill_middle"], sf)
