"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own centroids, so that the pairs of
centroids make a fine grid of cells from two small tables. A query walks the
pairs by summed distance, with a heap, until the cells it has met hold enough
entries; these are then ranked by their true distance. Rows lie in blocks and
queries in tiles, both in the order of their cells, so that queries of a tile
walk through much the same blocks; a block is sent only to tiles that visit it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import written
from .topk import finite

#: Rows that centroids are fitted on (about; twice as many at most), rows of an index block, and queries of a tile that one is held against.
TRAIN, BLOCK, TILE = 10_000, 4_096, 4_096
#: Rows that a cell should hold, and centroids of a half at most: the driver holds a count for each pair of them.
CELL, CENTROIDS = 48, 256


def centroids(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's means of the points, started at k of them; fewer points than k are their own means."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    means = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squares(points, means).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        for d in range(points.shape[1]):
            total = np.bincount(near, points[:, d], k)
            means[:, d] = np.where(count > 0, total / np.maximum(count, 1), means[:, d])
    return means


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in order of first[i] + second[j] until they hold `enough` rows; counts[i, j]: rows of a cell."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, held, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := int(counts[a[i], b[j]]):
            out.append((int(a[i]), int(b[j])))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def needed_share(points: np.ndarray, half: int, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, asked: int = 300) -> float:
    """The share of rows to look at so that about `recall` of the k nearest are met, from the sample the centroids were fitted on.

    For a larger table the same share meets no fewer, for its neighbours are nearer.
    """
    if len(points) <= k + 1:
        return 1.0
    first, second = books
    one, two = _squares(points[:, :half], first), _squares(points[:, half:], second)
    cell = one.argmin(axis=1) * len(second) + two.argmin(axis=1)
    counts = np.bincount(cell, minlength=len(first) * len(second))
    shares = []
    for i in range(0, len(points), -(-len(points) // asked)):
        far = _squares(points[i : i + 1], points)[0]
        far[i] = np.inf
        order = np.argsort((one[i][:, None] + two[i][None, :]).ravel(), kind="stable")
        met = np.empty(len(order))
        met[order] = np.cumsum(counts[order])
        shares.append(met[cell[np.argpartition(far, k)[:k]]] / len(points))
    return float(np.quantile(np.concatenate(shares), recall))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _laid(counts: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Cells side by side in portions of `size` rows, large ones over several: their counts, their first places, the size."""
    begun, at = {}, 0
    for cell in sorted(counts):
        begun[cell] = at
        at += counts[cell]
    return counts, begun, size


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found candidates other than the query, by Euclidean distance.

    `cells` centroids for each half (by default so many that a cell holds about
    CELL rows, CENTROIDS at most), fitted on about TRAIN rows; on these is
    also found what share of the rows a query has to look at for the `recall`
    wanted (little where vectors are clustered, most where they are noise).
    Every row is indexed. Rows with a null id, or a vector that is
    null, empty, zero or holds null or non-finite components, take no part, nor
    do queries and candidates of another dimension than most candidates have.
    Distances beyond the range of a double are infinite and come last. Rows that repeat an id are one
    row, with the least vector. Of candidates with the same vector only the
    k + 1 smallest ids can be in a result, so only these are indexed; nothing
    is lost by that. Ties go to the smaller id. An empty table gives an empty one.
    """
    spark = candidates.sparkSession

    def kind(df: DataFrame) -> str:  # floats go as they are, in half the bytes; distances are worked out in doubles
        return "float" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "double"

    def ready(df: DataFrame) -> DataFrame:
        vector = F.transform(vector_col, lambda x: x.cast(kind(df)))
        good = F.col(id_col).isNotNull() & finite(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    alike = W.partitionBy("v").orderBy("id")
    rows = written(ready(candidates).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).select("id", "v", F.size("v").alias("dim")), "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0]["dim"], dims[0]["count"]
    half = max(1, dim // 2)
    cells = cells or max(8, min(CENTROIDS, math.isqrt(total // CELL)))
    sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < TRAIN)).select("v").limit(2 * TRAIN).toArrow()
    points = _matrix(sample.column("v")) if len(sample) else _matrix(rows.where(F.col("dim") == dim).select("v").limit(1).toArrow().column("v"))
    fitted = centroids(points[:, :half], cells), centroids(points[:, half:], cells) if dim > half else np.zeros((1, 0))
    reach = max(20 * k, int(np.ceil(total * needed_share(points, half, fitted, k, recall))))
    books = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            v = _matrix(batch.column("v"))
            if len(v):
                cell = _squares(v[:, :half], first).argmin(axis=1) * len(second) + _squares(v[:, half:], second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    placed = written(rows.where(F.col("dim") == dim).select("id", "v").mapInArrow(place, f"id long, v array<{kind(candidates)}>, cell int"), "cells")
    asking = written(ready(queries).where(F.size("v") == dim).mapInArrow(place, f"id long, v array<{kind(queries)}>, cell int"), "queries")
    # As many counts as there are pairs of centroids, of rows and of queries.
    counted = lambda df: {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}
    layout = spark.sparkContext.broadcast((_laid(counted(placed), BLOCK), _laid(counted(asking), TILE)))

    def portion(which: int) -> Column:
        @F.pandas_udf("int")
        def number(cell: pd.Series, mix: pd.Series) -> pd.Series:
            table, begun, size = layout.value[which]
            return pd.Series([(begun[c] + m % table[c]) // size for c, m in zip(cell.tolist(), mix.tolist(), strict=True)], dtype="int32")

        return number("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        table, begun, size = layout.value[0]
        counts = np.zeros((len(first), len(second)), np.int64)
        for cell, n in table.items():
            counts[divmod(cell, len(second))] = n
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v):
                continue
            one, two = _squares(v[:, :half], first), _squares(v[:, half:], second)
            ids, near, met = [], [], []
            for i in range(len(v)):
                found = [x * len(second) + y for x, y in walk(one[i], two[i], counts, reach)]
                where: dict[int, list[int]] = {}
                for c in found:
                    for b in range(begun[c] // size, (begun[c] + table[c] - 1) // size + 1):
                        where.setdefault(b, []).append(c)
                for b, cs in where.items():
                    ids.append(i)
                    near.append(b)
                    met.append(cs)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("id", "v", "tile")], pa.array(near, pa.int32()), pa.array(met, pa.list_(pa.int32()))], ["query_id", "q", "tile", "block", "cells"])

    visits = asking.select("id", "v", portion(1).alias("tile")).mapInArrow(visit, f"query_id long, q array<{kind(queries)}>, tile int, block int, cells array<int>")
    asked = written(visits, "visits")
    pairs = asked.select(F.col("block").alias("visited"), F.col("tile").alias("by")).distinct()
    entries = placed.withColumn("block", portion(0)).join(pairs, F.col("block") == F.col("visited")).select("id", "v", "cell", "block", F.col("by").alias("tile"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            v, ids, cell = _matrix(left.column("v")), left.column("id").to_numpy(), left.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            v, ids, cell = v[order], ids[order], cell[order]
            starts = {int(c): (int(np.searchsorted(cell, c)), int(np.searchsorted(cell, c, "right"))) for c in np.unique(cell)}
            wanted = _matrix(right.column("q"))
            lengths, most = (v * v).sum(axis=1), (v * v).sum(axis=1).max()
            for begin in range(0, len(wanted), 256):
                part = slice(begin, begin + 256)
                rough = lengths[None, :] - 2 * wanted[part] @ v.T
                for q, near, own, cells_met in zip(wanted[part], rough, right.column("query_id")[part].to_pylist(), right.column("cells")[part].to_pylist(), strict=True):
                    spans = [starts[c] for c in cells_met if c in starts]
                    if not spans:
                        continue
                    at = np.concatenate([np.arange(a, b) for a, b in spans])
                    at = at[ids[at] != own]
                    if len(at) > k:  # those that rounding could put among the k nearest
                        rank = near[at]
                        at = at[rank <= np.partition(rank, k - 1)[k - 1] + 1e-9 * (most + (q * q).sum())]
                    gap = v[at] - q
                    far = np.sqrt((gap * gap).sum(axis=1))
                    out += [(own, i, s) for s, i in sorted(zip(far.tolist(), ids[at].tolist(), strict=True))[:k]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    partial = entries.groupBy("block", "tile").cogroup(asked.groupBy("block", "tile")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return partial.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
