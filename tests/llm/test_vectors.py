import math
import random

import numpy as np
import pytest

from spatialplate.llm import multi_index, topk
from spatialplate.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(spark, sf):
    return {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def plain_top(queries, vectors, k):
    whole = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors.items()}
    out = set()
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_top_k_query(spark, sf):
    vectors = rows_of(spark, sf)
    assert found(QUERIES["op9_exact_topk"](spark, sf)) == plain_top([i for i in vectors if i % 50 == 0], vectors, 5)


@pytest.mark.parametrize("size", [(16_384, 1_024), (7, 3)])
def test_top_k_in_tiles_with_ties(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "SHARD", size[0])
    monkeypatch.setattr(topk, "TILE", size[1])
    rng = random.Random(4)
    vectors = {i: [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)] for i in range(150)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], SCHEMA)
    assert found(topk.top_k(df.where("vec_id % 9 = 0"), df, 4)) == plain_top(range(0, 150, 9), vectors, 4)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS dim", "3 AS shard", "4 AS rank")
    assert found(topk.top_k(df, df, 5)) == {(0, 1, 6, 256 * 128), (0, 2, 8, 0), (6, 1, 0, 256 * 128), (6, 2, 8, 0), (8, 1, 0, 0), (8, 2, 6, 0)}
    assert topk.top_k(df.where("false"), df, 5).count() == 0 == topk.top_k(df, df.where("false"), 5).count()
    big = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 0.5])], SCHEMA)
    assert found(topk.top_k(big, big, 1)) == plain_top([0, 1], {0: [3e6, 1.0], 1: [3e6, 0.5]}, 1)


def plain_near(q, vectors, k):
    return sorted((float(np.sqrt(((np.array(v, float) - np.array(vectors[q], float)) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:k]


def test_multi_index_query_recall(spark, sf):
    vectors = rows_of(spark, sf)
    got = {}
    for r in QUERIES["op10_multi_index"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit = n = 0
    for q in (i for i in vectors if i % 100 == 0):
        want = plain_near(q, vectors, 10)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        for _, s, i in mine:
            assert abs(s - plain_near(q, {q: vectors[q], i: vectors[i]}, 1)[0][0]) < 1e-12
        hit += len({i for _, i in want} & {m[2] for m in mine})
        n += len(want)
    assert hit / n >= 0.9


def test_multi_index_on_clusters_and_copies(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    points = np.concatenate([np.repeat(centres[:1], 300, axis=0), centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.05])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], SCHEMA)
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    got = {}
    for r in multi_index.nearest(df.where("vec_id % 40 = 0"), df, 10).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert sorted(got[40]) == [(0.0, i) for i in range(10)] and sorted(got[0]) == [(0.0, i) for i in range(1, 11)]
    hit = sum(len({i for _, i in plain_near(q, vectors, 10)} & {i for _, i in g}) for q, g in got.items())
    assert hit >= 0.9 * 10 * len(got)


def test_multi_index_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS dim", "3 AS cell", "4 AS block")
    half, one = math.sqrt(0.5), math.sqrt(2)
    assert found(multi_index.nearest(df, df)) == {(0, 1, 6, half), (0, 2, 8, one), (6, 1, 0, half), (6, 2, 8, half), (8, 1, 6, half), (8, 2, 0, one)}
    assert multi_index.nearest(df, df.where("false")).count() == 0 == multi_index.nearest(df.where("false"), df).count()
    single = spark.createDataFrame([(0, [1.0]), (1, [3.0])], SCHEMA)
    assert found(multi_index.nearest(single, single)) == {(0, 1, 1, 2.0), (1, 1, 0, 2.0)}


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    first, second, counts = rng.random(6), rng.random(7), rng.integers(0, 4, (6, 7))
    cells = multi_index.walk(first, second, counts, 10**9)
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (counts > 0).sum()
    few = multi_index.walk(first, second, counts, 5)
    assert sum(counts[c] for c in few) >= 5 > sum(counts[c] for c in few[:-1]) and few == cells[: len(few)]


def test_scores_end_at_the_range_of_a_long(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0]), (3, [1e10, 1e10])], SCHEMA)
    most, least = (1 << 63) - 1, -(1 << 63)
    got = found(topk.top_k(df, df, 3))
    assert {g for g in got if g[0] == 0} == {(0, 1, 1, most), (0, 2, 3, most), (0, 3, 2, least)} and (2, 1, 0, least) in got
    far = multi_index.nearest(df, df, 3)
    assert {(r.query_id, r.vec_id) for r in far.collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}


def test_top_k_matches_sql(spark, sf):
    from spatialplate.llm.queries import SQL

    from ..oracle import duck_rows, spark_rows

    assert spark_rows(QUERIES["op9_exact_topk"](spark, sf)) == duck_rows(SQL["op9_exact_topk"], sf)


def test_many_levels_and_tiles(spark, monkeypatch):
    for module, name, value in ((topk, "SHARD", 2), (topk, "TILE", 5), (topk, "FAN", 3), (multi_index, "TILE", 4), (multi_index, "BLOCK", 16)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 4)))], SCHEMA)
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    some = df.where("vec_id % 5 = 0")
    assert found(topk.top_k(some, df, 4)) == plain_top(range(0, 60, 5), vectors, 4)
    got = {(r.query_id, r.vec_id) for r in multi_index.nearest(some, df, 4, cells=4, recall=1.0).collect()}
    assert len(got & {(q, i) for q in range(0, 60, 5) for _, i in plain_near(q, vectors, 4)}) >= 0.9 * 48


def test_blocks_go_only_to_tiles_that_visit_them(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "TILE", 8)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(16, 6))[np.arange(1600) % 16] * 9 + rng.normal(size=(1600, 6)) * 0.05
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], SCHEMA)
    tables, held = {}, multi_index.written

    def kept(table, name):
        tables[name] = held(table, name)
        return tables[name]

    monkeypatch.setattr(multi_index, "written", kept)
    some = df.where("vec_id % 10 < 1")
    got = multi_index.nearest(some, df, 5, cells=16).collect()
    pairs = {(r.block, r.tile) for r in tables["visits"].select("block", "tile").distinct().collect()}
    assert len({t for _, t in pairs}) == 20 and len(pairs) < 0.5 * 25 * 20
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    near = {(q, i) for q in range(0, 1600, 10) for _, i in plain_near(q, vectors, 5)}
    assert len(near & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(near)
    assert dict(tables["cells"].dtypes)["v"] == "array<float>"
    doubles = df.withColumn("embedding", df.embedding.cast("array<double>"))
    assert found(multi_index.nearest(some, doubles, 5, cells=16)) == {(r.query_id, r["rank"], r.vec_id, r.score) for r in got}
