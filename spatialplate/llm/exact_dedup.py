"""Exact deduplication with a split of heavy hitters, in DataFrame functions only.

Texts become digests once. A Misra-Gries summary (`freqItems`) names the digests
that may be frequent, an exact count keeps those that are, and their winners are
broadcast: their rows are decided where they lie. All other digests are rare, so
that an ordinary shuffle by digest deals them evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: A digest is heavy with more than one in COUNTERS of the rows. The summary has as many counters, so that it misses none, and at most as many winners are broadcast.
COUNTERS = 2_000
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes in lower-case hexadecimal digits; a null text counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, keep_row, group_size): the digests of more than one in `counters` rows of digests(digest, id, row), with their winners.

    The summary never leaves out such a digest, but may name others: the count drops these.
    """
    rows = digests.count()
    if not rows:
        return digests.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(0).cast("long").alias("group_size"))
    named = digests.freqItems(["digest"], 1.0 / counters).select(F.explode("digest_freqItems").alias("digest"))
    best = F.max(F.struct("id", (-F.col("row")).alias("before")))
    counted = digests.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    return counted.where(F.col("group_size") * counters > rows).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.before")).alias("keep_row"), "group_size")


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, carry: list[str] | None = None) -> DataFrame:
    """df's rows (the columns `carry`, or all) with keep_id, group_size, kept and text_sha256: of rows of equal text that of the largest id is kept.

    Texts are equal if they are the same bytes; null and empty ones are equal.
    Null ids come after all others, so that a group of them has a null keep_id.
    Of rows that repeat the largest id just one is kept: the first in the order
    in which Spark numbers them. Columns of the added names are replaced. All
    rows come out once; an empty table gives an empty one. Only digests and the
    columns carried are shuffled, texts just if they are carried.
    """
    names = [c for c in (df.columns if carry is None else carry) if c not in ADDED]
    # Numbers hold once they are written: a lost task can't deal them anew.
    rows = written(df.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("_")]).alias("r"), F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), digest(F.col(f"`{text_col}`")).alias("digest")), "digests")
    winners = F.broadcast(written(heavy_hitters(rows.select("digest", "id", "row"), counters), "winners"))
    own = [F.col(f"r.`{c}`").alias(c) for c in names]
    heavy = rows.join(winners, "digest").select(*own, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))
    group = W.partitionBy("digest").orderBy(F.desc_nulls_last("id"), "row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = rows.join(winners.select("digest"), "digest", "left_anti").withColumns({"keep_id": F.first("id").over(group), "keep_row": F.first("row").over(group), "group_size": F.count("*").over(group)})
    return heavy.unionByName(ranked.select(*own, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of df that marked() keeps, with df's columns."""
    held = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return marked(held, at[id_col], at[text_col], counters).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
