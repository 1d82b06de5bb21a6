import random
from collections import defaultdict

import pytest

from spatialplate.llm import ngram_join as J


def plain(rows):
    """(id, size, component) by all pairs."""
    sets = []
    for _, text in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    above = {i: i for i, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            where[t].append(k)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for t in s:
            for m in where[t]:
                if m < k:
                    common[m] += 1
        for m, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[m]) - n):
                a, b = top(rows[k][0]), top(rows[m][0])
                above[max(a, b)] = min(a, b)
    return {(i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True)}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in J.cluster(df).collect()}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    out = []
    while len(out) < n:
        kind, size = rng.random(), rng.choice([1, 3, 5, 6, 8, 9, 10, 14, 30, 60, 200])
        text = rng.choices(words, k=size)
        if kind < 0.35 and out:
            text = out[rng.randrange(len(out))].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.choice([0, 1, 1])] = rng.choices(words, k=rng.choice([0, 1]))
        elif kind < 0.5:
            at = rng.randrange(len(text))
            text[at:at] = passage
        out.append(" ".join(text))
    return list(zip(rng.sample(range(10 * n), n), out, strict=True))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("short", [24, 2])
def test_matches_all_pairs(spark, monkeypatch, seed, short):
    monkeypatch.setattr(J, "SHORT", short)
    rows = corpus(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("rounds", [8, 0])
def test_a_large_group_of_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "FREQUENT", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, "copied text of several words here") for i in range(1000, 1100)]
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            text[rng.randrange(60)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("light", [0, 4, 20, 64])
def test_any_boundary_is_right(spark, monkeypatch, light):
    monkeypatch.setattr(J, "boundary", lambda sets, percent: light)
    rows = corpus(7, 200)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "é É é É é"), (8, "é É é É é"), (8, "é É é É é"), (None, "a b"), (None, "z z z z z z"), (9, "word " * 30_000), (10, "word " * 30_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS node", "'k' AS key")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.cluster(df).collect()), key=str)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (8, 1, 7), (None, 1, 4), (None, 1, None), (9, 1, 9), (10, 1, 9)], key=str)
    assert J.cluster(df.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 200)]
    got = {r.node: r.component for r in J.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 0} | {100 + i: 100 for i in range(30)}


def test_later_links_go_through_components_only(spark, monkeypatch):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = J.components(edges([(i, i + 1) for i in range(10, 40)] + [(100 + i, 100) for i in range(1, 30)]))
    rows, components = [], J.components
    monkeypatch.setattr(J, "components", lambda links: (rows.append(links.count()), components(links))[1])
    got = {r.node: r.component for r in J.merged(first, edges([(10, 100), (5, 100), (300, 301)])).collect()}
    assert got == {i: 5 for i in (5, *range(10, 41), *range(100, 130))} | {300: 300, 301: 300} and rows == [3]


def test_labels_are_not_copied_to_every_part(spark, monkeypatch):
    """A round makes a row for each link and each node, not SALTS of them."""
    plans, written = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    J.components(spark.createDataFrame([(i, i + 1) for i in range(10)], "a long, b long"))
    assert plans and not any("Generate" in plan for plan in plans)


def test_query(spark, sf):
    from spatialplate.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op7_heavy_light_join"](spark, sf).collect()} == plain(rows)


def test_rows_that_repeat_an_id_are_one_document(spark):
    words = lambda x, n=12: " ".join(f"{x}{i}" for i in range(n))
    a, b, c, d = (words(x) for x in "abcd")
    near = words("c", 40)
    rows = [(10, a), (10, b), (5, a), (7, b), (20, c), (21, c), (22, d), (23, near), (24, near + " more"), (24, d), (30, ""), (30, None), (31, words("e")), (31, ""), (31, words("f")), (9, words("f")), (40, words("g"))]
    got = sorted((r.doc_id, r.component_id) for r in J.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(10, 5), (10, 5), (5, 5), (7, 5), (20, 20), (21, 20), (22, 22), (23, 22), (24, 22), (24, 22), (30, 30), (30, 30), (31, 9), (31, 9), (31, 9), (9, 9), (40, 40)])
