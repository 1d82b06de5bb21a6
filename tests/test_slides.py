"""Files in and out, and the rules for odd input."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spatialplate import sinks, sources
from spatialplate.functions import geometry as G
from spatialplate.operators import calibrate, classes, clean, collection, plate, sample, validate
from spatialplate.plans import jobs

# Fixed golden values: an outline of a public example and a box of it, and its calibration points (p2, p3, p4 below);
# the cutting job further down is what the instrument must be given for them.
OUTLINE = [[584, 760], [613, 800], [618, 808], [615, 829], [636, 820], [809, 755], [782, 682], [584, 760]]
BOX = [[160, 140], [160, 263], [244, 263], [244, 140], [160, 140]]


def feature(id_, kind, coordinates, **properties):
    return {"type": "Feature", "id": id_, "geometry": {"type": kind, "coordinates": coordinates}, "properties": {"objectType": "annotation", **properties}}


def klass(name):
    return {"name": name, "color": [3, 128, 17]}


FEATURES = [
    feature("a", "Polygon", [OUTLINE], classification=klass("class_2")),
    feature("b", "Polygon", [BOX], classification=klass("class_1")),
    feature("c", "LineString", [[0, 0], [631.33, 163.33]], classification="{'name': 'class_3', 'color': [1, 2, 3]}"),
    feature("d", "MultiPolygon", [[BOX]], classification=klass("class_1")),
    feature("e", "MultiPoint", [[1, 2]], classification=klass("class_1")),
    feature("f", "Polygon", [BOX]),
    feature("g", "Polygon", [BOX], classification={"color": [1, 2, 3]}),
    feature("p1", "Point", [1, 1], name="calib1"),
    feature("p2", "Point", [893.85, 43.09], name="calib2"),
    feature("p3", "Point", [42.33, 619.4], name="calib3"),
    feature("p4", "Point", [931.08, 875.18], name="calib1"),
    feature("p5", "Point", [5, 5], name=""),
    feature("p6", "Point", [5, 5]),
]


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("slides")
    for stem, rows in (("one", FEATURES), ("two.v2", FEATURES[:2] + FEATURES[7:10])):
        (top / f"{stem}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    return sources.read_features(spark, str(top)).cache()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def table(spark, **wells):
    return spark.createDataFrame([(c, w, i) for i, (c, w) in enumerate(wells.items())], "class_name string, well string, ord int")


def test_scan_keeps_order_and_flattens(features):
    one = features.where("slide_id = 'one'").orderBy("ord").collect()
    assert [r.id for r in one] == [f["id"] for f in FEATURES]
    assert {r.slide_id for r in features.select("slide_id").distinct().collect()} == {"one", "two.v2"}
    assert len(one[0].rings[0]) == 8 and one[3].rings is None and tuple(one[8].point) == (893.85, 43.09)


def test_feature_lines_give_the_same(spark, features, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(f | {"slide_id": "one", "ord": i}) for i, f in enumerate(FEATURES)))
    lines = sources.read_feature_lines(spark, str(tmp_path))
    assert lines.where("slide_id = 'one'").drop("geometry").orderBy("ord").collect() == features.where("slide_id = 'one'").drop("geometry").orderBy("ord").collect()


def test_cleaning(features):
    one = features.where("slide_id = 'one'")
    assert {(r.id, r.class_name) for r in clean.shapes(one).collect()} == {("a", "class_2"), ("b", "class_1"), ("c", "class_3"), ("g", None)}
    assert {(r.id, r.reason.split(":")[0]) for r in clean.rejected(one).collect()} == {("d", "several polygons in one feature"), ("e", "unsupported geometry")}
    assert clean.unclassified(one).first().n == 1
    assert clean.census_text(one).first().report == "1 LineStrings, 1 MultiPoints, 1 MultiPolygons, 4 Polygons, 6 Points"


def test_a_repeated_point_has_its_last_place_and_first_position(features):
    found = {r.name: (r.x, r.y, r.first_ord) for r in clean.calibration_points(features.where("slide_id = 'one'")).collect()}
    assert found == {"calib1": (931.08, 875.18, 7), "calib2": (893.85, 43.09, 8), "calib3": (42.33, 619.4, 9)}


def test_coverage_and_missing_points(spark, features):
    points = clean.calibration_points(features)
    triangles = calibrate.triangles(calibrate.default_selection(points), points)
    one = calibrate.coverage(clean.shapes(features), triangles).where("slide_id = 'one'").first()
    assert (one.shapes, one.hits, one.report) == (4, 1, "25.00%")
    chosen = spark.createDataFrame([("one", 1, "calib1"), ("one", 2, "nowhere")], "slide_id string, pos int, name string")
    assert [r.name for r in calibrate.missing(chosen, points).collect()] == ["nowhere"]
    empty = calibrate.coverage(clean.shapes(features).where("false"), triangles).first()
    assert (empty.shapes, empty.share, empty.status) == (0, None, "no shapes")


def test_splitting_twice_changes_nothing(features):
    shapes = clean.shapes(features.where("slide_id = 'one'")).withColumn("class_name", F.lit("k"))
    once = classes.split_classes(shapes, ["k"])
    assert [r.class_name for r in once.orderBy("ord").collect()] == ["k_001", "k_002", "k_003", "k_004"]
    assert classes.split_classes(once, ["k"]).orderBy("ord").collect() == once.select(classes.split_classes(once, ["k"]).columns).orderBy("ord").collect()
    named = classes.renamed_classification(once).orderBy("ord").first().classification
    assert named.name == "k_001" and list(named.color) == [3, 128, 17]


def test_maps_are_read_leniently(spark, tmp_path):
    for i, text in enumerate(['﻿{\n "a" : "C3",\n "b":"C5",\n}', "{'a': 'C3'}", "no map", ""]):
        (tmp_path / f"{i}.txt").write_text(text)
    read = lambda i: [(r.class_name, r.well, r.ord) for r in sources.read_class_wells(spark, str(tmp_path / f"{i}.txt")).orderBy("ord").collect()]
    assert read(0) == [("a", "C3", 0), ("b", "C5", 1)] and read(1) == [("a", "C3", 0)] and read(2) == read(3) == []


@pytest.mark.parametrize(("plate_type", "margin", "down", "along"), [("384", 0, 1, 1), ("384", 1, 2, 3), ("96", 3, 1, 1), ("96", 4, 1, 1), ("96", 9, 1, 1), ("384", -2, 5, 7)])
def test_wells(spark, plate_type, margin, down, along):
    r, c = (16, 24) if plate_type == "384" else (8, 12)
    m = max(0, margin)
    want = [f"{chr(64 + i)}{j}" for i in range(1 + m, r - m + 1, down) for j in range(1 + m, c - m + 1, along)]
    got = sources.wells(spark.range(1), plate_type, margin, down, along).orderBy("pos").collect()
    assert [x.well for x in got] == want and [x.pos for x in got] == list(range(1, len(want) + 1))


def test_arguments_are_checked(spark):
    for bad in (lambda: sources.wells(spark.range(1), "95"), lambda: sources.wells(spark.range(1), margin="1"), lambda: sources.wells(spark.range(1), step_row=0), lambda: validate.checked_map([]), lambda: validate.checked_map({}), lambda: validate.checked_map({"a": 1}), lambda: classes.combinations(None, None, 0)):
        with pytest.raises(ValueError):
            bad()
    assert validate.checked_map({"a": "A1"}) == {"a": "A1"}


def test_layouts(spark):
    c = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "class_name string")
    wells = sources.wells(spark.range(1), "96", 3)
    usable = plate.classes_of(c)
    assert rows(plate.assign(usable, wells)) == [("a", "D4", 1), ("b", "D5", 2), ("c", "D6", 3)]
    mixed = plate.assign(usable, wells, seed=1)
    assert rows(mixed) == rows(plate.assign(usable, wells, seed=1)) and {r.class_name for r in mixed.collect()} == set("abc")
    few = wells.where("pos <= 2")
    assert rows(plate.unplaced(usable, few)) == [("c",)] and plate.capacity(usable, few).first().fits is False
    assert rows(plate.known_cells(c.na.drop(), usable.where("class_name <> 'c'")), "class_name", "available") == [("a", True), ("b", True), ("c", False)]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefghij"), st.sampled_from([f"{r}{c}" for r in "ABH" for c in (1, 2, 10, 12)]), min_size=1, max_size=8))
def test_unpivot_undoes_pivot(spark, mapping):
    last = {w: c for c, w in mapping.items()}
    placed = plate.placed_on_grid(table(spark, **mapping), sources.plate_grid(spark.range(1), "96"))
    assert {r.class_name: r.well for r in plate.unpivoted(plate.pivoted(placed, "96")).collect()} == {c: w for w, c in last.items()}


def test_validation_levels(spark, features):
    mapping = table(spark, class_1="C3", class_2="Z9", other="C3")
    report = validate.quality_report(features, features.select("slide_id").distinct().unionByName(spark.createDataFrame([("three",)], "slide_id string")), mapping)
    found = {(r.slide_id, r.check, r.detail): (r.severity, r.n) for r in report.collect()}
    assert found["three", "empty_input", ""] == ("error", 0) and found["one", "unclassified", ""] == ("warn", 1)
    assert found[None, "missing_class", "class_3"][0] == "warn" and found[None, "invalid_well", "class_2 Z9"][0] == "error"
    assert found[None, "shared_well", "C3: class_1, other"][0] == "info" and found["one", "coverage", "25.00%"][0] == "info"
    assert found["one", "no_well", "class_3"] == ("warn", 1)


def test_cutting_job_and_plate_files(spark, features, tmp_path):
    mapping = table(spark, class_1="C3", class_2="C5", class_3="C7")
    jobs.collect_slides(spark, features, mapping, str(tmp_path)).count()
    text = next((tmp_path / "xml/slide_id=one").glob("part-*")).read_text()
    assert text.startswith("<?xml version='1.0' encoding='UTF-8'?>\n<ImageData>\n  <GlobalCoordinates>1</GlobalCoordinates>\n  <X_CalibrationPoint_1>93108</X_CalibrationPoint_1>\n  <Y_CalibrationPoint_1>-87518</Y_CalibrationPoint_1>\n")
    assert "  <ShapeCount>3</ShapeCount>\n  <Shape_1>\n    <PointCount>6</PointCount>\n    <CapID>C5</CapID>\n    <X_1>58400</X_1>\n    <Y_1>-76000</Y_1>\n    <X_2>61800</X_2>\n" in text
    assert "<Y_2>-16334</Y_2>\n  </Shape_3>\n</ImageData>\n" in text and text.endswith("</ImageData>\n")
    csv = next((tmp_path / "plate_384").glob("part-*")).read_text().split("\n")
    assert csv[0] == "," + ",".join(map(str, range(1, 25))) and csv[1] == "A" + "," * 24 and csv[3] == "C,,,class_1,,class_2,,class_3" + "," * 17 and len(csv) == 18
    assert next((tmp_path / "map").glob("part-*")).read_text() == '{"class_1":"C3","class_2":"C5","class_3":"C7"}\n'
    back = [json.loads(x) for x in next((tmp_path / "features/slide_id=one").glob("part-*")).read_text().splitlines()]
    assert [b["id"] for b in back] == ["a", "b", "c", "g"] and back[0]["geometry"]["coordinates"] == [OUTLINE] and back[0]["properties"]["classification"]["name"] == "class_2"


def test_collections_can_be_read_again(spark, features, tmp_path):
    sinks.write_features(clean.shapes(features), str(tmp_path / "out"), collection=True)
    again = sources.read_features(spark, [str(p) for p in tmp_path.glob("out/slide_id=one/part-*")])
    assert [(r.id, r.rings) for r in again.orderBy("ord").collect()] == [(r.id, r.rings) for r in clean.shapes(features).where("slide_id = 'one'").orderBy("ord").collect()]


def test_export_names_the_columns_that_hold_nulls(features):
    assert rows(sinks.export_errors(features.where("slide_id = 'one'")), "column", "n") == [("classification", 7)]


def test_statistics(spark, features):
    outlined = collection.outlines(collection.with_wells(clean.shapes(features), table(spark, class_1="C3")))
    r = collection.statistics(outlined).where("slide_id = 'one'").first()
    assert (r.shapes, r.min_vertices, r.median_vertices, r.x_min, r.x_max, r.y_min, r.y_max) == (1, 5, 5.0, 16000, 24400, -26300, -14000)
    left = collection.without_wells(clean.shapes(features).where("slide_id = 'one'"), table(spark, class_1="C3", class_2="C4"))
    assert {(r.class_name, r.n) for r in left.collect()} == {("class_3", 1), (None, 1)}


def test_sampling_inside_regions(spark):
    square = lambda x, y, s: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]]
    schema = "slide_id string, id string, rings array<array<struct<x:double,y:double>>>"
    regions = spark.createDataFrame([("s", "r1", square(0, 0, 600)), ("s", "r2", square(1000, 1000, 50)), ("t", "r3", square(0, 0, 600))], schema)
    cells = spark.createDataFrame([("s", f"d{i}", square(10 + 60 * i, 250, 4)) for i in range(12)] + [("s", "far", square(2000, 0, 4))], schema)
    found = sample.inside(cells, regions)
    assert {(r.annotation_id, r.id) for r in found.collect()} == {("r1", f"d{i}") for i in range(10)}
    picked = sample.sampled(found, 3, 1)
    assert picked.where("selected").count() == 3 and sample.sampled(found, 99, 1).where("selected").count() == 10
    assert rows(picked) == rows(sample.sampled(found, 3, 1))


def test_conversion_gives_new_ids(spark):
    df = spark.createDataFrame([("a", "detection", True, "n"), ("b", "detection", False, "n"), ("c", "annotation", True, "n"), ("d", "detection", None, "n")], "id string, object_type string, selected boolean, name string")
    out = sample.converted(df).collect()
    assert {r.id for r in out} & set("abcd") == set("bcd")
    new = next(r for r in out if r.id not in "bcd")
    assert (new.object_type, new.name) == ("annotation", None) and len(out) == 4


def test_lists_and_palettes(spark):
    text = spark.createDataFrame([(" a, ,b ,",), ("",)], "t string")
    items = sources.exploded_list(text, F.col("t"))
    assert rows(items) == [(0, "a"), (1, "b")]
    combined = classes.combinations(items, items, 2)
    assert [r.class_name for r in combined.orderBy("pos").collect()] == ["a_a_1", "a_a_2", "a_b_1", "a_b_2", "b_a_1", "b_a_2", "b_b_1", "b_b_2"]
    palette = json.loads(sinks.palette_text(combined).first().value)["pathClasses"]
    assert palette[0] == {"name": "a_a_1", "color": -65536} and palette[6]["color"] == -65536


def test_numbers_do_not_depend_on_ranges(spark, monkeypatch):
    import random

    from spatialplate.operators import numbering

    monkeypatch.setattr(numbering, "CHUNK", 7)
    rows = [(random.Random(i).choice(["a", "b", None]), i * 3 % 101) for i in range(101)]
    got = numbering.numbered(spark.createDataFrame(rows, "k string, ord long").withColumn("_size", F.lit(1)), "n", ("k",))
    assert got.columns == ["k", "ord", "_size", "n"]
    for key in ("a", "b", None):
        orders = [r.ord for r in sorted(got.collect(), key=lambda r: r.n) if r.k == key]
        assert orders == sorted(o for k, o in rows if k == key) and [r.n for r in got.orderBy("n").collect() if r.k == key] == list(range(1, len(orders) + 1))


def test_sampling_on_grids_of_several_sizes(spark):
    import random

    rng = random.Random(2)
    square = lambda x, y, r: [[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]]
    regions = [(f"a{i}", rng.uniform(0, 900), rng.uniform(-300, 900), rng.choice([3, 20, 90, 400])) for i in range(40)]
    spots = [(f"d{i}", rng.uniform(0, 900), rng.uniform(-300, 900), 1.0) for i in range(150)]
    table = lambda rows: spark.createDataFrame([("s", i, square(x, y, r)) for i, x, y, r in rows], "slide_id string, id string, rings array<array<struct<x:double,y:double>>>")
    got = {(r.annotation_id, r.id) for r in sample.inside(table(spots), table(regions)).collect()}
    assert got == {(a, d) for a, ax, ay, r in regions for d, x, y, _ in spots if abs(x - ax) < r and abs(y - ay) < r}
    assert sample.inside(table(spots), table(regions).where("false")).count() == 0


def circle(x, y, r, n=8):
    points = [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [[{"x": a, "y": b} for a, b in (*points, points[0])]]


def test_a_region_of_the_slides_size_is_many_keys(spark):
    """All points of a slide in one corner, under an annotation of the slide's size with a hole and a small one."""
    from spatialplate.operators.sample import LEVELS, _fine, _pieces, leaves

    frame = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in ([(-10, -10), (90_000, -10), (90_000, 70_000), (-10, 70_000), (-10, -10)], [(200, 200), (300, 200), (300, 300), (200, 300), (200, 200)])]
    schema = "slide_id string, id string, rings array<array<struct<x:double,y:double>>>"
    regions = spark.createDataFrame([("s", "all", frame), ("s", "small", circle(500.0, 500.0, 40.0)), ("t", "far", circle(5e5, -4e5, 3e5)), (None, "x", frame), ("s", "none", None)], schema)
    spots = spark.range(30_000).selectExpr("'s' AS slide_id", "concat('d', id) AS id", "(id * 37 % 997) * 1.0 AS x", "(id * 91 % 991) * 1.0 AS y").unionByName(spark.range(50).selectExpr("'t'", "concat('e', id)", "id * 20000.0", "-id * 15000.0").toDF("slide_id", "id", "x", "y"))
    cells = spots.selectExpr("slide_id", "id", "array(array(struct(x - 1 AS x, y - 1 AS y), struct(x + 1 AS x, y - 1 AS y), struct(x AS x, y + 2 AS y), struct(x - 1 AS x, y - 1 AS y))) AS rings")
    got = {(r.slide_id, r.annotation_id, r.id) for r in sample.inside(cells, regions).collect()}
    near = lambda r, cx, cy, radius: math.dist((r.x, r.y), (cx, cy)) < radius * math.cos(math.pi / 8)
    rows = spots.collect()
    border = {r.id for r in rows if r.x in (200.0, 300.0) or r.y in (200.0, 300.0)}
    assert {g[2] for g in got if g[1] == "all"} - border == {r.id for r in rows if r.slide_id == "s" and not (200 < r.x < 300 and 200 < r.y < 300)} - border
    assert {r.id for r in rows if r.slide_id == "s" and near(r, 500, 500, 40)} <= {g[2] for g in got if g[1] == "small"} <= {r.id for r in rows if near(r, 500, 500, 44)}
    assert {r.id for r in rows if r.slide_id == "t" and near(r, 5e5, -4e5, 3e5)} <= {g[2] for g in got if g[1] == "far"}
    # Each leaf holds its share at most, and most of the large region needs no test of points.
    points = spots.select("slide_id", _fine("x").alias("cx"), _fine("y").alias("cy"))
    dealt = leaves(points, 128).cache()
    per_leaf = points.join(dealt, ["slide_id", "cx", "cy"]).groupBy("slide_id", "leaf", F.expr("shiftright(cx, leaf)"), F.expr("shiftright(cy, leaf)")).count()
    assert per_leaf.where("leaf > 0").agg(F.max("count")).first()[0] <= 128 and per_leaf.where("slide_id = 's'").count() > 200
    assert {r.leaf for r in dealt.select("leaf").distinct().collect()} <= set(LEVELS)
    areas = regions.where("id = 'all' AND slide_id = 's'").select("slide_id", F.col("id").alias("annotation_id"), G.edges(F.col("rings")).alias("edges"), *[F.lit(v).alias(c) for c, v in (("x0", -10.0), ("y0", -10.0), ("x1", 90_000.0), ("y1", 70_000.0))])
    pieces = _pieces(areas, dealt)
    assert pieces.where("whole").count() > 0.8 * pieces.count()


def test_samples_are_the_least_by_the_seed(spark):
    import hashlib

    rows = [("s", a, i) for a in ("a", "b") for i in range(200 if a == "a" else 3)] + [("t", "a", 7)]
    found = spark.createDataFrame(rows, "slide_id string, annotation_id string, id long")
    for n in (0, 1, 5, 500):
        got = sample.sampled(found, n, 9)
        assert got.columns == ["slide_id", "annotation_id", "id", "selected"]
        want = set()
        for key in {r[:2] for r in rows}:
            mine = sorted((hashlib.md5(f"9:{i}".encode()).hexdigest(), i) for s, a, i in rows if (s, a) == key)
            want |= {(*key, i) for _, i in mine[:n]}
        assert {(r.slide_id, r.annotation_id, r.id) for r in got.where("selected").collect()} == want and got.count() == len(rows)
    plan = sample.sampled(found, 2, 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_samples_in_regions_write_no_pairs(spark, monkeypatch):
    """300 detections at one place in 100 annotations of one outline, and some elsewhere."""
    table = lambda rows: spark.createDataFrame(rows, "slide_id string, id long, rings array<array<struct<x:double,y:double>>>")
    spots = table([("s", i, circle(50.0, 60.0, 2.0)) for i in range(300)] + [("s", 1000 + i, circle(40.0 + i, 60.0, 2.0)) for i in range(40)] + [("t", 1, circle(50.0, 60.0, 2.0)), ("s", 5, circle(52.0, 60.0, 2.0))])
    regions = table([("s", i, circle(50.0, 60.0, 6.0)) for i in range(100)] + [("s", 200, circle(70.0, 60.0, 30.0)), ("s", 201, circle(500.0, 60.0, 3.0)), ("t", 1, circle(50.0, 60.0, 6.0)), ("t", 2, None)])
    written, settled = [], sample.settled

    def counted(df, name):
        out = settled(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(sample, "settled", counted)
    for n in (0, 1, 4, 1000):
        got = sample.sampled_inside(spots, regions, n, 9)
        assert got.columns == ["slide_id", "annotation_id", "id", "selected"]
        most = max(written)
        want = sample.sampled(sample.inside(spots, regions), n, 9)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30_000 > 400 > most
        written.clear()


def test_shapes_are_not_sent_to_their_triangles(spark, sf):
    """A slide of any size is many tasks: only the small side of the join is sent."""
    from spatialplate.plans import queries

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as for tables too large to be broadcast by their size
    try:
        plan = queries.triangle_hits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    shapes = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in shapes and "SortMergeJoin" not in shapes and "Exchange hashpartitioning" not in shapes


def test_the_report_reads_features_twice(spark, features, tmp_path, monkeypatch):
    features.write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    mapping = table(spark, class_1="C3", class_2="Z9", other="C3")
    plans = []
    held = validate.settled
    monkeypatch.setattr(validate, "settled", lambda df, name: plans.append(df) or held(df, name))
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        report = validate.quality_report(kept, features.select("slide_id").distinct(), mapping)
        scans = sum(df._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/kept") for df in [*plans, report])
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert scans == 2 and rows(report, "check", "n", "detail") == rows(validate.quality_report(features, features.select("slide_id").distinct(), mapping), "check", "n", "detail")
