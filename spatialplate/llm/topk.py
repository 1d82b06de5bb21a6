"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Candidates are dealt out to shards and queries to tiles, both of bounded size.
Every (tile, shard) pair is one matrix product in the task that holds the shard,
which keeps the k best of each query; lists are then merged over groups of
shards, over groups of these, and so on. Nothing whole passes through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARD, TILE, FAN = 8_192, 1_024, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a whole number, at the ends of its range where it is beyond them."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(dim, name, ids array<long>, kind, cells binary): rows of df(id, v) in blocks of about `size` rows of one dimension; and how many there are."""
    n = max(1, -(-df.count() // size))

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        cells = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        low, high = int(cells.min()), int(cells.max())
        kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)  # narrow numbers are less to ship
        return pa.table({"dim": group.column("dim").slice(0, 1), name: group.column(name).slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64())), "kind": [kind], "cells": pa.array([cells.astype(kind).tobytes()], pa.binary())})

    dealt = df.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), F.col("id").cast("long").alias("id"), "v")
    return dealt.groupBy("dim", name).applyInArrow(run, f"dim int, {name} int, ids array<long>, kind string, cells binary"), n


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where all sums stay exact, else in Python's integers, at the ends of a long where they are beyond them."""
    reach = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if reach < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if reach < 1 << 53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    return np.minimum(np.maximum(q.astype(object) @ c.astype(object).T, LEAST), MOST)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best of one row, ties to the smaller id, without the query's own rows."""
    near = np.arange(len(ids))
    if len(ids) > 4 * k + 64 and scores.dtype != object:
        more = k + int((ids == own).sum())
        least = np.partition(scores, len(ids) - more)[len(ids) - more] if more < len(ids) else scores.min()
        near = np.flatnonzero(scores >= least)
    near = near[ids[near] != own]
    found = sorted(zip((-scores[near]).tolist(), ids[near].tolist(), strict=True))[:k]
    return [(int(-s), i) for s, i in found]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates other than itself, ties to the smaller id.

    Components count as floor(scale * x); components and scores beyond the range
    of a long count as its ends. Rows with a null id, or a vector that
    is null, empty or holds null or non-finite components, take no part;
    vectors of another dimension are no candidates. Rows that repeat an id are
    one row, with the least of their vectors. With fewer candidates than k all are returned; an empty table
    gives an empty one.
    """
    ready = lambda df: df.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    blocks, width = _blocks(ready(candidates), SHARD, "shard")
    shards = written(blocks, "shards")
    tiles = _blocks(ready(queries), TILE, "tile")[0].select("dim", "tile", F.col("ids").alias("query_ids"), F.col("kind").alias("query_kind"), F.col("cells").alias("query_cells"))
    # A query set against all rows, in blocks: tiles, the smaller side, go to each shard; one without rows of their dimension meets none.
    sent = tiles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    pairs = sent.hint("merge").join(shards, ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cell = lambda name: batch.column(name)[i]  # noqa: B023, E731
                dim = cell("dim").as_py()
                q = np.frombuffer(cell("query_cells").as_py(), cell("query_kind").as_py()).reshape(-1, dim)
                c = np.frombuffer(cell("cells").as_py(), cell("kind").as_py()).reshape(-1, dim)
                ids, own = cell("ids").values.to_numpy(), cell("query_ids").values.to_numpy().tolist()
                lists = [_best(s, ids, o, k) for s, o in zip(_products(q, c), own, strict=True)]
                flat = [(o, cell("shard").as_py(), i, s) for o, found in zip(own, lists, strict=True) for s, i in found]
                if flat:
                    columns = list(zip(*flat, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["query_id", "shard", "vec_id", "score"])

    merged = pairs.select("dim", "shard", "ids", "kind", "cells", "query_ids", "query_kind", "query_cells").mapInArrow(run, "query_id long, shard int, vec_id long, score long")
    best = [F.desc("score"), F.asc("vec_id")]
    while True:
        width = -(-width // FAN)
        merged = merged.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k)
        if width == 1:
            return merged.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, min([floor(256 * CAST(x AS DOUBLE)) for x in embedding]) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
