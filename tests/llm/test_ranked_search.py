import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spatialplate.llm import ranked_search
from spatialplate.llm.queries import QUERIES, SQL

from ..oracle import duck_rows, spark_rows


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    n_all, l_all = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, words in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in words if df[t]}
        scores = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_all) // l_all if l_all else 0
            scores.append((-sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t]), i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(x for x in sorted(scores)[:k] if x[0] < 0)}
    return out


def found(df):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()}


WORDS = [f"w{i}" for i in range(60)]


def corpus(rng, n, longest=80):
    text = lambda size: " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=size))
    return [(i, text(rng.randint(0, longest))) for i in range(n)]


@pytest.mark.parametrize(("shard", "block", "tile", "fan"), [(8 << 20, 128, 512, 16), (2_000, 4, 3, 2)])
def test_search_against_plain_version(spark, monkeypatch, shard, block, tile, fan):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("TILE", tile), ("FAN", fan)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(block)
    docs = corpus(rng, 400)
    docs += [(500, None), (501, ""), (502, "—"), (None, "w1 w2"), (503, "Ünï w1 W1 É é"), (503, "w1 w2"), (503, "w1 w2"), (504, "w59 " * 30_000), (505, "a\x00b_c-D9é"), *[(600 + i, "w5 w7 w9") for i in range(120)]]
    items = [(i, t) for i, t in corpus(rng, 20, 40)] + [(90, None), (91, ""), (92, "no such terms"), (93, "W5 w7!"), (94, "b É c D9É"), (None, "w1"), (95, "w3"), (95, "w4 w3"), (96, "w59")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS shard", "3 AS score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS term")
    got = ranked_search.search(ranked_search.build(df), asked, 7)
    assert found(got) == plain(docs, items, 7) and got.count() == len(plain(docs, items, 7))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = ranked_search.build(docs)
    assert found(ranked_search.search(index, items)) == plain([(1, "a b"), (2, "b")], [(1, "a")], 50)
    assert ranked_search.search(index, items.where("false")).count() == 0 == ranked_search.search(ranked_search.build(docs.where("false")), items).count()


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    rng = random.Random(3)
    texts = [" ".join(["common"] * rng.randint(1, 3) + ["often"] * rng.randint(0, 1) + [f"x{rng.randint(0, 9)}"] * rng.randint(1, 400)) for _ in range(2_000)]
    for i in (5, 900, 1_500):
        texts[i] = "rare common often"
    batch = ranked_search._shard(0, pa.array(range(2_000)), pa.array(texts))
    row = {name: batch.column(name)[0] for name in batch.schema.names}
    lists = ranked_search._Lists(row, 2_000, sum(len(terms(t)) for t in texts))
    names = lists.terms.to_pylist()
    asked = [(names.index("rare"), 6000), (names.index("often"), 600), (names.index("common"), 300)]
    ids, scores = ranked_search.best_of_shard(lists, asked, np.empty(0, np.int64), 3)
    assert set(ids.tolist()) == {5, 900, 1_500} and len(set(scores.tolist())) == 1
    assert lists.read < 0.1 * len(lists.last)
    whole = ranked_search._Lists(row, 2_000, sum(len(terms(t)) for t in texts))
    every = ranked_search.best_of_shard(whole, asked, np.empty(0, np.int64), 5_000)
    assert dict(zip(*map(np.ndarray.tolist, every), strict=True))[900] == scores[0] and whole.read > 0.1 * len(lists.last)
    # A threshold from other shards that nothing here reaches.
    assert not len(ranked_search.best_of_shard(whole, asked, np.full(3, 1 << 60), 3)[0])


def test_lists_are_unpacked_as_they_were(monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    texts = ["b " * (i % 5 * 300) + "a c" for i in range(30)]
    batch = ranked_search._shard(7, pa.array(range(100, 130)), pa.array(texts))
    lists = ranked_search._Lists({name: batch.column(name)[0] for name in batch.schema.names}, 30, 9_000)
    for term, n in enumerate(lists.df.tolist()):
        blocks = -(-n // 4)
        whole = lists.blocks(term, np.arange(blocks))
        for b in range(blocks):
            some = lists.blocks(term, np.array([b]))
            assert some[0].tolist() == whole[0][4 * b : 4 * b + 4].tolist() and some[1].tolist() == whole[1][4 * b : 4 * b + 4].tolist()
            assert some[1].max() <= lists.bounds[lists.first_block[term] + b]


def test_query_matches_sql(spark, sf):
    assert spark_rows(QUERIES["op11_block_max_search"](spark, sf)) == duck_rows(SQL["op11_block_max_search"], sf)
