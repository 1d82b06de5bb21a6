import hashlib
import random
from collections import defaultdict

import pytest

from spatialplate.llm import exact_dedup
from spatialplate.llm.queries import QUERIES, SQL

from ..oracle import duck_rows, spark_rows

SCHEMA = "doc_id long, text string, keep_id string, r int, row int, digest int"


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept, left = left and i == keep, left and i != keep
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("counters", [3, 10, 2_000])
def test_groups_against_plain_version(spark, counters):
    rng = random.Random(counters)
    rows = [(i, rng.choice(["hot", "hot", "warm", f"text {i % 40}", f"own {i}", "Ω≈ç", " hot"])) for i in range(300)]
    rows += [(None, "hot"), (None, "alone"), (None, "alone"), (7, None), (8, ""), (9, "hot"), (9, "hot"), (900, "hot"), (900, "hot"), (901, "x" * 300_000), (902, "x" * 300_000)]
    got = exact_dedup.marked(table(spark, rows), counters=counters)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got.collect()) == plain(rows)
    assert got.columns == ["doc_id", "text", "r", "row", "digest", "keep_id", "group_size", "kept", "text_sha256"]
    left = exact_dedup.deduplicated(table(spark, rows), counters=counters)
    assert left.columns == table(spark, []).columns and left.count() == len({t or "" for _, t in rows}) and left.where("keep_id = 'own'").count() == left.count()


def test_empty_and_all_alike(spark):
    assert exact_dedup.marked(table(spark, [])).count() == 0
    out = exact_dedup.marked(table(spark, [(5, "same")] * 50), carry=["doc_id"]).collect()
    assert sum(r.kept for r in out) == 1 and {r.group_size for r in out} == {50}


def test_heavy_digests_are_found_and_rare_ones_dropped(spark):
    rows = spark.range(10_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 10 = 1 THEN 'b' ELSE concat('own', id) END AS digest", "id", "id AS row")
    heavy = {r.digest: (r.keep_id, r.keep_row, r.group_size) for r in exact_dedup.heavy_hitters(rows, 20).collect()}
    assert heavy == {"a": (9_999, 9_999, 3_334), "b": (9_991, 9_991, 667)}


def test_no_python_and_no_text_in_the_shuffle(spark, sf):
    plan = QUERIES["op13_heavy_split_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and "text:string" not in plan


def test_query_matches_sql(spark, sf):
    assert spark_rows(QUERIES["op13_heavy_split_dedup"](spark, sf)) == duck_rows(SQL["op13_heavy_split_dedup"], sf)
