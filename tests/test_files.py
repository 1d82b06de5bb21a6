"""Large files, in many tasks."""

import json
import random
import sys
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spatialplate import sinks, sources
from spatialplate.operators import clean, collection as jobs
from spatialplate.plans import jobs as plans
from spatialplate.sources import split
from spatialplate.sources.split import _masked


def collection(rng, n):
    odd = ['a"b', "a}b{", "[x", "back\\slash", "\\", '\\"', "é語", "}{", "", "tab\t"]
    rows = []
    for i in range(n):
        ring = [[rng.randint(0, 999) / 2, rng.randint(0, 999) / 2] for _ in range(rng.choice([3, 5, 200 if i % 50 == 0 else 4]))]
        properties = {"objectType": "annotation", "name": rng.choice(odd), "classification": {"name": rng.choice(odd), "color": [1, 2, 3]}, "more": [{"features": [{"x": 1}]}]}
        kind, where = rng.choice([("Polygon", [[*ring, ring[0]]]), ("Point", ring[0]), ("LineString", ring)])
        feature = {"type": "Feature", "id": f"{i}-{rng.choice(odd)}", "geometry": {"type": kind, "coordinates": where}, "properties": properties}
        rows.append(dict(rng.sample(list(feature.items()), 4)))
    return rows


@pytest.mark.parametrize("size", ["700b", "5k", "128m"])
def test_split_files_give_what_whole_ones_do(spark, tmp_path, size):
    rng = random.Random(size)
    for stem, n, indent in (("one", 120, None), ("two.x", 60, 1), ("three", 0, None)):
        (tmp_path / f"{stem}.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "u}"}}, "features": collection(rng, n), "after": {"a": [1]}}, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "other.geojson").write_text('{"type": "Feature", "geometry": null}')
    (tmp_path / "empty.geojson").write_text("")
    bare = lambda df: sorted(map(str, df.withColumn("geometry", F.struct("geometry.type", F.regexp_replace("geometry.coordinates", r"\s+", ""))).collect()))
    want = bare(sources.read_features(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        if size == "700b":
            assert spark.read.text(str(tmp_path / "one.geojson"), lineSep="}").rdd.getNumPartitions() > 8
        got = sources.read_large_features(spark, str(tmp_path))
        assert bare(got) == want and len(want) == 180
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_that_breaks_off_gives_its_whole_features(spark, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": collection(random.Random(3), 20)})
    (tmp_path / "cut.json").write_text(text[: text.rindex('"type": "Feature"') - 1])
    got = sources.read_large_features(spark, str(tmp_path)).where("type IS NOT NULL").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(got))) and len(got) >= 18


def test_strings_are_blotted_out():
    assert _masked('{"a": "b}\\"", [', False) == ("{xxx: xxxxxx, [", False)
    assert _masked('b" x "c', True) == ("xx x xx", True) and _masked("no end", True) == ("xxxxxx", True)
    assert _masked('"a\\\\" {', False) == ("xxxxx {", False) and _masked('"a\\"', False)[1] and _masked('"', False)[1]


def test_a_slide_is_written_by_many_tasks(spark, tmp_path):
    """The parts of a job and of a collection, one after the other, are what one task would write."""
    rng = random.Random(8)
    ring = lambda: [{"x": float(rng.randint(0, 99)), "y": float(rng.randint(0, 99))} for _ in range(5)]
    rows = [("one" if i % 10 else "two", i, f"id{i}", [ring()]) for i in range(400)]
    shapes = spark.createDataFrame(rows, "slide_id string, ord long, id string, rings array<array<struct<x:double,y:double>>>")
    shapes = shapes.selectExpr("*", "'Polygon' AS type", "'annotation' AS object_type", "'k' AS class_name", "named_struct('name', 'k', 'color', array(1, 2, 3)) AS classification").withColumn("geometry", F.struct("type", F.to_json(F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))).alias("coordinates")))
    points = spark.createDataFrame([(s, [{"x": 1.0, "y": 2.0}] * 3) for s in ("one", "two")], "slide_id string, points array<struct<x:double,y:double>>")
    lines = jobs.xml_lines(jobs.outlines(jobs.with_wells(shapes, spark.createDataFrame([("k", "A1")], "class_name string, well string")), None), points)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_xml(lines, str(tmp_path / "xml"))
        sinks.write_features(shapes, str(tmp_path / "json"), collection=True)
        text = lambda top, slide: "".join(p.read_text() for p in sorted((tmp_path / top / f"slide_id={slide}").glob("part-*")))
        assert len(list((tmp_path / "xml/slide_id=one").glob("part-*"))) > 3 and not list(tmp_path.glob("*/_aside*"))
        for slide in ("one", "two"):
            ordered = lines.where(F.col("slide_id") == slide).orderBy("shape_no", "line_no").collect()
            assert text("xml", slide) == "".join(r.s + "\n" for r in ordered)
            assert [f["id"] for f in json.loads(text("json", slide))["features"]] == [r[2] for r in rows if r[0] == slide]
        again = sources.read_large_features(spark, str(tmp_path / "json"))
        assert [(r.slide_id, r.ord, r.id, r.rings) for r in again.orderBy("slide_id", "ord").collect()] == [(s, n, r.id, r.rings) for s in ("one", "two") for n, r in enumerate(shapes.where(F.col("slide_id") == s).orderBy("ord").collect())]
        sinks.write_xml(lines.where("slide_id = 'two' AND shape_no < 3"), str(tmp_path / "xml"), keep=True)
        assert text("xml", "two").count("<Shape_") == 2 and text("xml", "one").count("<Shape_") == 360
        sinks.write_xml(lines.where("slide_id = 'two'"), str(tmp_path / "xml"))
        assert not (tmp_path / "xml/slide_id=one").exists() and clean.shapes(again).count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_only_changed_slides_are_worked_on(spark, tmp_path, monkeypatch):
    top, out = tmp_path / "in", str(tmp_path / "out")
    top.mkdir()
    square = lambda x: [[[x, 0], [x + 9, 0], [x + 9, 9], [x, 9], [x, 0]]]

    def put(stem, *xs):
        shapes = [{"type": "Feature", "id": f"{x}", "geometry": {"type": "Polygon", "coordinates": square(x)}, "properties": {"objectType": "annotation", "classification": {"name": "k"}}} for x in xs]
        points = [{"type": "Feature", "id": f"p{i}", "geometry": {"type": "Point", "coordinates": [i, i * i]}, "properties": {"objectType": "annotation", "name": f"c{i}"}} for i in range(3)]
        (top / f"{stem}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": shapes + points}))

    for stem in "abc":
        put(stem, 1, 20)
    wells = lambda well: spark.createDataFrame([("k", well, 1)], "class_name string, well string, ord int")
    run = lambda well="C3": plans.collect_changed(spark, str(top), wells(well), out)
    text = lambda stem: "".join(p.read_text() for p in sorted((tmp_path / f"out/xml/slide_id={stem}").glob("part-*")))
    assert {r.slide_id for r in run().collect()} >= set("abc") and all(text(s).count("<Shape_") == 2 for s in "abc")
    read = []
    held = sources.read_large_features
    monkeypatch.setattr(sources, "read_large_features", lambda spark, paths: read.append(sorted(p[-9:-8] for p in paths)) or held(spark, paths))
    assert run() is None and read == []
    put("b", 1, 20, 40)
    put("d", 5)
    (top / "c.geojson").touch()
    assert run() is not None and read == [["b", "d"]]
    assert [text(s).count("<Shape_") for s in "abcd"] == [2, 3, 2, 1]
    assert run() is None and len(read) == 1
    (top / "a.geojson").unlink()
    assert run() is None and len(read) == 1
    assert run("D4") is not None and read[1] == ["b", "c", "d"] and "<CapID>D4</CapID>" in text("c") and "C3" in text("a")


def test_the_parts_of_a_slide_change_together(spark, tmp_path):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (9, 0), (9, 9), (0, 9), (0, 0))]
    rows = [(s, i, f"id{i}", [ring]) for s in ("one", "two") for i in range(200)]
    shapes = spark.createDataFrame(rows, "slide_id string, ord long, id string, rings array<array<struct<x:double,y:double>>>")
    shapes = shapes.selectExpr("*", "'Polygon' AS type", "'annotation' AS object_type", "named_struct('name', 'k', 'color', array(1, 2, 3)) AS classification").withColumn("geometry", F.struct("type", F.to_json(F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))).alias("coordinates")))
    wells = spark.createDataFrame([("k", "A1", 1)], "class_name string, well string, ord int")
    run = lambda: plans.collect_changed(spark, str(tmp_path / "in"), wells, str(tmp_path / "out"))
    ids = lambda slide: [json.loads(x)["id"] for p in sorted((tmp_path / f"out/features/slide_id={slide}").glob("part-*")) for x in p.read_text().splitlines()]
    slides = lambda report: {r.slide_id for r in report.collect() if r.slide_id}
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_features(shapes, str(tmp_path / "in"), collection=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert slides(run()) == {"one", "two"} and ids("one") == ids("two") == [f"id{i}" for i in range(200)]
    parts = sorted((tmp_path / "in/slide_id=one").glob("part-*"))
    assert len(parts) > 2
    middle = parts[1].read_text()
    held = middle.count('"id":"id')
    (tmp_path / f"in/slide_id=one/.{parts[1].name}.crc").unlink(missing_ok=True)
    parts[1].write_text(middle.replace('"id":"id', '"id":"new'))
    assert slides(run()) == {"one"} and len(ids("one")) == 200 and sum(i.startswith("new") for i in ids("one")) == held > 0
    parts[1].unlink()
    assert slides(run()) == {"one"} and len(ids("one")) == 200 - held and run() is None


def test_stored_features_are_numbered_without_an_exchange(spark, sf, tmp_path):
    from spatialplate.plans import queries

    kept = sinks.store_features(queries.features(spark, sf), "kept_features", 4, str(tmp_path / "kept"))
    shapes = clean.shapes(kept)
    some = spark.createDataFrame([(r.class_name, "A1") for r in shapes.select("class_name").distinct().orderBy("class_name").limit(3).collect()], "class_name string, well string")
    got = jobs.with_wells(shapes, F.broadcast(some), stored=True).select("slide_id", "ord", "shape_no")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    want = jobs.with_wells(clean.shapes(queries.features(spark, sf)), some).select("slide_id", "ord", "shape_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    spark.sql("DROP TABLE kept_features")


def split_batches(text, ends, rows):
    """The batches of one file that is cut at the braces behind `ends`, with a row for each fragment."""
    cuts = [0, *(text.index("}", e) + 1 for e in ends), len(text)]
    for place, (begin, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        fragments = text[begin:end].split("}")
        if end < len(text):
            fragments.pop()
        for i in range(0, len(fragments), rows):
            some = fragments[i : i + rows]
            same = {"path": "p", "file": "f", "block": begin, "source": "p", "place": place, "last": end == len(text)}
            yield begin, same, pa.RecordBatch.from_pylist([same | {"value": x} for x in some])


def with_beginnings(batches):
    batches = list(batches)
    told = pd.DataFrame([r for b in split._summed(b for _, _, b in batches) for r in b.to_pylist()]).assign(source="p")
    begins = {r["block"]: {k: r[k] for k in ("inside", "braces", "brackets", "number")} for r in split._chained(told).to_dict("records")}
    return [pa.RecordBatch.from_pylist([r | begins[block] for r in b.to_pylist()]) for block, _, b in batches]


@pytest.mark.parametrize(("chunk", "rows"), [(1, 7), (5, 1), (64, 1000), (2_000_000, 50)])
def test_texts_are_read_alike_in_pieces_of_any_size(monkeypatch, chunk, rows):
    monkeypatch.setattr(split, "CHUNK", chunk)
    want = collection(random.Random(chunk), 40)
    text = json.dumps({"type": "FeatureCollection", "features": want, "after": {"a": ["}\\\""]}}, ensure_ascii=False)
    found = [r for b in split._features(iter(with_beginnings(split_batches(text, [len(text) // 3, len(text) // 2, len(text) - 2], rows)))) for r in b.to_pylist()]
    texts = {}
    for r in sorted(found, key=lambda r: (r["ord"], r["place"])):
        texts[r["ord"]] = texts.get(r["ord"], "") + r["text"]
    assert [json.loads(texts[i]) for i in range(len(texts))] == want and any(r["part"] for r in found)


def test_readers_take_no_step_for_each_fragment():
    rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": {"classification": {"name": "k"}}} for i in range(2000)]
    text = json.dumps({"features": rows})
    first = {"path": "p", "file": "f", "block": 0, "source": "p", "place": 0, "inside": False, "braces": 0, "brackets": 0, "number": 0, "last": True}
    batch = pa.RecordBatch.from_pylist([first | {"value": x} for x in text.split("}")])
    steps = Counter()
    sys.setprofile(lambda frame, event, arg: steps.update([event]))
    try:
        told, found = list(split._summed(iter([batch]))), list(split._features(iter([batch])))
    finally:
        sys.setprofile(None)
    assert len(told) == 1 and sum(b.num_rows for b in found) == 2000
    assert sum(steps.values()) < batch.num_rows / 2


def test_rows_are_worked_out_once_however_they_are_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).selectExpr("id % 3 AS slide_id", "id AS ord", "CAST(id AS STRING) AS value").mapInArrow(counted, "slide_id long, ord long, value string")
    sinks.write_ordered(rows, str(tmp_path / "rows"), "ord")
    assert seen.value == 3000 and spark.read.text(str(tmp_path / "rows")).count() == 3000


def test_shapes_stay_where_they_are_for_rows_of_their_slides(spark):
    """With no join broadcast by size: cutting jobs and features are written without a join that sorts shapes by slide."""
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (9, 0), (9, 9), (0, 0))]
    outlined = spark.createDataFrame([("one", 1, "A1", ring)], "slide_id string, shape_no int, well string, pts array<struct<x:double,y:double>>")
    triangles = spark.createDataFrame([("one", ring[:3])], "slide_id string, points array<struct<x:double,y:double>>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jobs.xml_lines(outlined, triangles)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan
        shapes = spark.createDataFrame([("one", 1, "id", "annotation", ("k", [1]), ("Point", "[1]"))], "slide_id string, ord long, id string, object_type string, classification struct<name:string,color:array<int>>, geometry struct<type:string,coordinates:string>")
        assert "SortMergeJoin" not in sinks.collection_lines(shapes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
