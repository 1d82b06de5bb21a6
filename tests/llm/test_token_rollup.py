import pytest

from spatialplate.llm import token_rollup as T
from spatialplate.llm.queries import QUERIES, SQL

from ..oracle import duck_rows, spark_rows

SCHEMA = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches_add_up_once(spark, tmp_path):
    rollup = T.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {} and rollup.committed() == []
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, 0), ("insert", "a", "en", "v1", 5, 0), ("insert", None, None, "v1", None, 0), ("insert", "a", "en", "v2", 7, 0)], SCHEMA)
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    second = spark.createDataFrame([("delete", "a", "en", "v1", 5, 0), ("revise", "a", "en", "v1", 12, 10), ("delete", "a", "en", "v2", 7, 0)], SCHEMA)
    assert rollup.commit("two", second)
    assert totals(T.Rollup(spark, f"file://{tmp_path}/r")) == {("a", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0)}
    assert rollup.commit("three", first.where("false")) and rollup.committed() == ["batch=one", "batch=three", "batch=two"]


def test_a_failed_batch_is_not_in_force_and_can_come_again(spark, tmp_path):
    rollup = T.Rollup(spark, f"file://{tmp_path}/r")
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("x", spark.createDataFrame([("upsert", "a", "en", "v", 1, 0)], SCHEMA))
    assert rollup.committed() == []
    (tmp_path / "r" / "batch=y").mkdir(parents=True, exist_ok=True)
    (tmp_path / "r" / "batch=y" / "part-0.parquet").write_bytes(b"half")
    assert totals(rollup) == {}
    good = spark.createDataFrame([("insert", "a", "en", "v", 1, 0)], SCHEMA)
    assert rollup.commit("x", good) and rollup.commit("y", good) and totals(rollup) == {("a", "en", "v"): (2, 2)}
    with pytest.raises(ValueError, match="name"):
        rollup.commit("../z", good)


def test_counts(spark):
    df = spark.createDataFrame([("a b\n--  c1",), (None,), ("",)], "text string")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in df.select(*[T.n_tokens(F.col("text"), v).alias(v) for v in T.PATTERNS]).collect()]
    assert got == [(4, 3, 5), (0, 0, 0), (0, 0, 0)]


def test_query_matches_sql(spark, sf):
    assert spark_rows(QUERIES["op6_token_rollup"](spark, sf)) == duck_rows(SQL["op6_token_rollup"], sf)


def test_null_ids_and_clashing_names(spark, tmp_path):
    rows = [(1, "a b", "s", "en"), (None, "c d e", "s", "en"), (None, "a b", "s", "en"), (None, None, "s", "en"), (2, "", "s", "en"), (None, "c d e", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS row", "2 AS words", "3 AS same", "4 AS tokens", "'x' AS op")
    assert totals(T.maintained(spark, docs, f"file://{tmp_path}/r")) == {("s", "en", "words"): (4, 5), ("s", "en", "pieces"): (4, 5)}
    assert totals(T.maintained(spark, docs.where("false"), f"file://{tmp_path}/e")) == {}


def test_a_snapshot_is_kept_and_writers_do_not_race(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    row = spark.createDataFrame([("insert", "a", "en", "v", 3, 0)], SCHEMA)
    for k in range(4):
        assert T.Rollup(spark, path).commit(f"b{k}", row)
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.name[0] != ".") == ["version-2", "version-3"] and totals(T.Rollup(spark, path)) == {("a", "en", "v"): (4, 12)}
    mine, other, renamed = T.Rollup(spark, path), T.Rollup(spark, path), T.Rollup._renamed

    def late(self, old, new):
        if self is mine and "x" not in {n.removeprefix("batch=") for n in other.committed()}:
            assert other.commit("x", row)  # another writer takes the number first
        return renamed(self, old, new)

    monkeypatch.setattr(T.Rollup, "_renamed", late)
    assert mine.commit("y", row) and totals(mine) == {("a", "en", "v"): (6, 18)} and not mine.commit("x", row)


def test_tokens_by_a_vocabulary(spark):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb").read().splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "some words, and 123 more", "s", "en"), (2, None, None, None), (None, "é" * 50, "s", "fr")]
    got = T.vocabulary_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), path, "bytes-50k").collect()
    assert {tuple(r) for r in got} == {(i, s, k, "bytes-50k", len(library.encode_ordinary(t or ""))) for i, t, s, k in rows}
