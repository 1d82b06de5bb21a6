import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from spatialplate.llm import language_id, ngram_join, pii  # noqa: E402

from .test_line_dedup import plain as plain_lines  # noqa: E402
from .test_ngram_join import plain as plain_groups  # noqa: E402
from .test_packing import check  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = pipeline.languages(spark, docs, sf)
    model = language_id.fit(docs)
    before = docs.orderBy("doc_id").collect()
    names = model.predict([r.text for r in before])[0]
    want = [r for r, n in zip(before, names, strict=True) if n != "und"]
    assert known.columns == docs.columns and known.orderBy("doc_id").collect() == want and len(want) > 0.9 * len(before)
    fewer = pipeline.lines(spark, known, sf).orderBy("doc_id").collect()
    assert [r.text for r in fewer] == plain_lines([(r.source, r.text) for r in want], 8, 4) and all(r.n_chars == len(r.text) for r in fewer)
    once = pipeline.near_duplicates(spark, spark.createDataFrame(fewer, docs.schema), sf).orderBy("doc_id").collect()
    groups = {i: c for i, _, c in plain_groups([(r.doc_id, r.text) for r in fewer])}
    assert once == [r for r in fewer if groups[r.doc_id] == r.doc_id]
    clean = pipeline.surrogates(spark, spark.createDataFrame(once, docs.schema), sf).orderBy("doc_id").collect()
    assert [r.doc_id for r in clean] == [r.doc_id for r in once]
    assert all(a.text == b.text if not pii.find(b.text) else a.text != b.text for a, b in zip(clean, once, strict=True))
    packed = pipeline.sequences(spark, spark.createDataFrame(clean, docs.schema), sf).collect()
    check(packed, {r.doc_id: r.text for r in clean})
    assert {tuple(r) for r in pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_odd_documents(spark, tmp_path):
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "12 34", None, None, 5), (None, "the cat and the hat", None, None, 19), (None, "the cat and the hat", None, None, 19), (4, "the cat and the hat", "en", None, 19),
        (5, "the cat and the hat", "en", "b", 19), (6, "ann@x.org " + "word " * 20_000, "en", "b", 1), (6, "ann@x.org " + "word " * 20_000, "en", "b", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece) for r in out if r.doc_id) == [(4, 0), *[(6, k) for k in range(len(out) - 3)]] and sum(r.doc_id is None for r in out) == 2
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["languages", "lines", "near_duplicates", "surrogates", "sequences"] and ngram_join.LIGHT > 0
