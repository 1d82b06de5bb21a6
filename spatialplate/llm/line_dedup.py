"""Line deduplication by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line whose share of the host's pages exceeds a
ratio is boilerplate there and is dropped from the host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A host's boilerplate is broadcast up to so many lines in all (8 bytes each), else joined by salted keys.
BROADCAST, SALTS = 500_000, 32


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without a leading www.; null where it has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(df: DataFrame, host: Column, text: Column, percent: int, least: int) -> DataFrame:
    """(host, lines array<long>): hashes of each host's boilerplate.

    A host has at most (mean distinct lines of its pages) * 100 / percent such
    lines, so an array is bounded by its pages' shape and not by their number.
    """
    pages = df.select(_host_key(host).alias("host"), F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _hash)).alias("seen"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("seen").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(totals, "host").where(F.col("n") * 100 > F.col("pages") * percent).groupBy("host").agg(F.collect_list("line").alias("lines"))


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", percent: int = 8, least: int = 4) -> DataFrame:
    """df with boilerplate lines taken out of `text_col`, and _lines and _dropped: a text's lines and how many went.

    A line counts once for each page (row) that has it, trimmed of blanks; it
    goes if it is on at least `least` pages and on more than `percent` percent
    of its host's pages. Blank lines are never counted or dropped. A null text
    stays null, with 0 lines; an empty one has one empty line. A text that
    loses all lines becomes empty. Pages with a null host are one host. Tabs and
    carriage returns are part of a line, not blanks. host_of() makes hosts of
    addresses. All
    columns and repeated rows stay; an empty table gives an empty one. Lines
    are told apart by 64-bit hashes within their host.
    """
    bad = written(boilerplate(df, F.col(host_col), F.col(text_col), percent, least), "boilerplate")
    n = bad.agg(F.sum(F.size("lines"))).first()[0] or 0
    keyed = df.select("*", _host_key(F.col(host_col)).alias("_host"))
    sites = bad.select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    if n <= BROADCAST:
        joined = keyed.join(F.broadcast(sites), "_host", "left")
    else:  # a host may hold a third of all pages
        salted = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # By the row's number, for most rows of a host may be copies of one text; any salt finds the same lines.
        joined = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).hint("merge").join(salted, ["_host", "_salt"], "left")
    kept = F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains("_bad", _hash(x)))
    out = joined.withColumn("_all", _lines(F.col(text_col))).withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_all")).otherwise(kept))
    return out.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns],
        F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("_lines"),
        F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all") - F.size("_kept")).cast("long").alias("_dropped"),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line) <> '' GROUP BY 1, 2) l
  JOIN pages p ON p.source IS NOT DISTINCT FROM l.source WHERE l.n >= 4 AND l.n * 100 > p.n * 8
), marked AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM l.source AND b.line = trim(l.line)
)
SELECT d.doc_id, d.source,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '') END AS text,
  CAST(count(m.pos) AS BIGINT) AS n_lines, CAST(count(m.pos) FILTER (WHERE m.gone) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.source, d.text
"""
