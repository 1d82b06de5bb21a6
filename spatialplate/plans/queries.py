"""The registered queries of the slide operators, over the driver's tables, with their SQL.

Features come from `events`: an octagon, line or point for each event. Classes
of plate queries come from `part`, a layout for each p_size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import geometry as G
from ..functions import names as N
from ..operators import calibrate, classes, clean, collection, plate, sample, validate
from ..schemas import FEATURE_LINE
from ..staging import folder, settled
from . import jobs

CORNERS = ((1.0, 0.5), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.5), (-1.0, -0.5), (-0.5, -1.0), (0.5, -1.0), (1.0, -0.5), (1.0, 0.5))
#: A closed outline that plain thinning at a tolerance of 2 makes cross itself. Every fourth event has it with two points exchanged, so that it crosses itself from the start.
WINDING = (
    (8.24, 6.7), (3.25, 3.5), (2.88, 3.26), (0.85, 4.6), (-1.46, 6.95), (-0.88, 2.33), (-4.8, 5.59), (-5.42, 6.29),
    (-4.12, 4.23), (-3.35, 1.49), (-9.79, -1.85), (-7.06, -4.43), (-3.36, -2.3), (-9.7, -6.92), (-2.75, -3.46), (8.24, 6.7),
)
TWISTED = (*WINDING[:4], WINDING[9], *WINDING[5:9], WINDING[4], *WINDING[10:])
SEED, TOLERANCE = 7, 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 10 == 0, "Point").when(e % 10 == 1, "LineString").when(e % 10 == 2, "MultiPolygon").otherwise("Polygon")
    cx, cy, r = ((e * 37 % 1000).cast("double"), (e * 91 % 1000).cast("double"), (e % 20 + 5).cast("double"))
    ring = F.array(*[F.struct((cx + r * x).alias("x"), (cy + r * y).alias("y")) for x, y in CORNERS])
    name = F.when(e % 17 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("slide_id"), e.alias("ord"), e.alias("id"), kind.alias("type"),
        F.when(e % 3 == 0, "detection").otherwise("annotation").alias("object_type"),
        F.when(e % 10 == 0, F.concat(F.lit("calib"), (F.floor(e / 10) % 5).cast("string"))).alias("name"),
        F.when(name.isNotNull(), F.struct(name.alias("name"), F.array(F.lit(3), F.lit(128), F.lit(17)).alias("color"))).alias("classification"),
        F.struct(kind.alias("type"), F.concat(F.lit("[["), F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), p.x.cast("string"), F.lit(","), p.y.cast("string"), F.lit("]"))), ","), F.lit("]]")).alias("coordinates")).alias("geometry"),
        F.when(kind.isin("Polygon", "LineString"), F.array(ring)).alias("rings"),
        F.when(kind == "Point", F.struct(cx.alias("x"), cy.alias("y"))).alias("point"),
    )


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("slide_id")).distinct()


def slide_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types but the last by name, on the wells of a 96 plate with margin 2."""
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("class_name")).distinct()
    last = found.agg(F.max("class_name").alias("_last"))
    return plate.assign(found.join(F.broadcast(last), F.col("class_name") < F.col("_last")).drop("_last"), sources.wells(spark.range(1), "96", 2))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("study"), F.col("p_brand").alias("class_name")).distinct()


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("study"), F.concat_ws("_", "p_brand", "p_type").alias("class_name")).distinct()


def study_wells(classes_: DataFrame, plate_type: str = "384", margin: int = 1, row: int = 2, col: int = 2) -> DataFrame:
    return sources.wells(classes_.select("study").distinct(), plate_type, margin, row, col, ("study",))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.shapes(features(spark, sf_dir))


def _triangles(f: DataFrame) -> DataFrame:
    points = clean.calibration_points(f)
    return calibrate.triangles(calibrate.default_selection(points), points)


# Queries


def feature_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.census(features(spark, sf_dir)).orderBy(F.desc("n"), "slide_id", "type")


def census_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.census_text(features(spark, sf_dir))


def clean_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select("slide_id", "ord", "type", "class_name")


def rejected_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.rejected(features(spark, sf_dir))


def json_property_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.nulls(features(spark, sf_dir).select("slide_id", "id", "name", "classification", "rings"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.quality_report(features(spark, sf_dir), slides(spark, sf_dir), slide_map(spark, sf_dir), plate="96")


def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.calibration_points(features(spark, sf_dir))


def calibration_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = slides(spark, sf_dir).select("slide_id", F.posexplode(F.array(*map(F.lit, ("calib1", "calib7", "calib3")))).alias("pos", "name"))
    return calibrate.missing(chosen, clean.calibration_points(features(spark, sf_dir)))


def triangle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return calibrate.coverage(clean.shapes(f), _triangles(f)).select("slide_id", "shapes", "hits", F.round("share", 9).alias("share"), "status")


def triangle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return calibrate.hits(clean.shapes(f), _triangles(f)).select("slide_id", "ord", "hit")


def closed_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = _triangles(features(spark, sf_dir)).select("slide_id", F.posexplode(G.closed_triangle(F.col("points"))).alias("i", "p"))
    return corners.select("slide_id", "i", "p.x", "p.y")


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(F.lit("slide."), e.cast("string"), F.when(e % 3 > 0, F.concat(F.lit("."), "event_type")).otherwise(""), F.lit(".geojson"))
    return table(spark, sf_dir, "events").select("event_id", N.file_stem(name).alias("stem"))


def acceptable_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("slide_id")
    return sources.wells(slides(spark, sf_dir), "384", s % 3, s % 2 + 1, s % 3 + 1, ("slide_id",)).select("slide_id", "well", "row_idx", "col_idx", "pos")


def plate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slides(spark, sf_dir)
    usable = sources.wells(found, "96", F.col("slide_id") % 3, keys=("slide_id",))
    return plate.flagged(sources.plate_grid(found, "96", keys=("slide_id",)), usable, ("slide_id",)).select("slide_id", "well", "cell", "available")


def assign_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = brands(spark, sf_dir)
    return plate.assign(c, study_wells(c), ("study",))


def assign_wells_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = brands(spark, sf_dir)
    return plate.assign(c, study_wells(c), ("study",), SEED)


def plate_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crowded(spark, sf_dir)
    return plate.unplaced(c, study_wells(c, "96", 0, 1, 2), ("study",))


def plate_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crowded(spark, sf_dir)
    return plate.capacity(c, study_wells(c, "96", 0, 1, 2), ("study",))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = brands(spark, sf_dir)
    grid = sources.plate_grid(c.select("study").distinct(), keys=("study",))
    return plate.placed_on_grid(plate.assign(c, study_wells(c), ("study",), SEED), grid, ("study",))


def plate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plate.pivoted(_placed(spark, sf_dir), "384", ("study",))


def plate_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plate.unpivoted(plate_pivot(spark, sf_dir), ("study",)).select("study", "class_name", "well")


def map_missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing_classes(_shapes(spark, sf_dir), slide_map(spark, sf_dir), ())


def map_invalid_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crowded(spark, sf_dir)
    return validate.invalid_wells(plate.assign(c, study_wells(c, "384", 0, 1, 1), ("study",)), "96").select("study", "class_name", "well")


def map_shared_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = crowded(spark, sf_dir)
    return validate.shared_wells(plate.assign(c, study_wells(c, "384", 0, 1, 1), ("study",)))


def map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = brands(spark, sf_dir)
    return sinks.map_text(plate.assign(c, study_wells(c), ("study",)), ("study",))


def map_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("﻿{'"), "p_brand", F.lit("': 'A1', '"), "p_type", F.lit("' : 'B2',}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(sources.parsed_map(text)).alias("ord", "class_name", "well"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.exploded_list(table(spark, sf_dir, "part"), F.concat(F.lit(" "), "p_brand", F.lit(", ,"), "p_type", F.lit(",,  "), "p_name"), "p_partkey")


def split_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _shapes(spark, sf_dir).withColumn("slide_id", F.lit(0))
    named = shapes.agg(F.min("class_name").alias("a"), F.max("class_name").alias("b")).select(F.explode(F.array("a", "b")).alias("original_class_name"))
    out = classes.renamed_classification(classes.split_classes(classes.split_classes(shapes, named), named))
    return out.select("slide_id", "ord", "original_class_name", "class_name", F.col("classification.name").alias("classification_name"))


def shape_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.with_wells(_shapes(spark, sf_dir), slide_map(spark, sf_dir)).select("slide_id", "ord", "class_name", "well", "shape_no")


def shapes_without_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.without_wells(_shapes(spark, sf_dir), slide_map(spark, sf_dir))


def _outlined(spark: SparkSession, sf_dir: str, tolerance: float | None = TOLERANCE) -> DataFrame:
    return collection.outlines(collection.with_wells(_shapes(spark, sf_dir), slide_map(spark, sf_dir)), tolerance)


def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.statistics(_outlined(spark, sf_dir))


def transform_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlined(spark, sf_dir, None).select("slide_id", "shape_no", F.posexplode("pts").alias("i", "p")).select("slide_id", "shape_no", "i", "p.x", "p.y")


def simplify_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    simple = G.exterior(G.simplified(F.col("rings"), TOLERANCE))
    return _shapes(spark, sf_dir).select("slide_id", "ord", simple.alias("pts")).select("slide_id", "ord", F.posexplode("pts").alias("i", "p")).select("slide_id", "ord", "i", "p.x", "p.y")


def outline_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sides that meet in winding outlines; and after thinning, in those that have none."""
    e = F.col("event_id")
    at = lambda points: F.array(F.array(*[F.struct(((e * 37 % 1000) + F.lit(x)).alias("x"), ((e * 91 % 1000) + F.lit(y)).alias("y")) for x, y in points]))
    rings = table(spark, sf_dir, "events").select(e.alias("ord"), F.when(e % 4 == 3, at(TWISTED)).otherwise(at(WINDING)).alias("rings"))
    met = rings.select("ord", G.meetings(F.col("rings")).alias("before"), G.simplified(F.col("rings"), 2.0).alias("thin"))
    return met.select("ord", "before", F.when(F.col("before") == 0, G.meetings(F.col("thin"))).alias("after"))


def collection_xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.xml_lines(_outlined(spark, sf_dir), _triangles(features(spark, sf_dir)))


def combinations_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(column: str) -> DataFrame:
        found = table(spark, sf_dir, "part").select(F.col(column).alias("item")).distinct()
        return found.agg(F.sort_array(F.collect_list("item")).alias("l")).select(F.posexplode("l").alias("pos", "item"))

    return classes.combinations(listed("p_brand"), listed("p_type"), 3)


def palette_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.palette_text(combinations_palette(spark, sf_dir))


def colour_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    packed = N.packed_colour(k % 256, k * 7 % 256, k * 13 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", packed.alias("color"), *[F.get(N.unpacked_colour(packed), F.lit(i)).alias(c) for i, c in enumerate("rgb")])


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    polygons = features(spark, sf_dir).where(F.col("type") == "Polygon")
    return polygons.where(F.col("object_type") == "detection"), polygons.where(F.col("object_type") == "annotation")


def sample_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sampled_inside(*_regions(spark, sf_dir), 1, SEED)


def convert_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = features(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("selected", F.col("ord") % 2 == 0)
    return sample.converted(marked).select("slide_id", "ord", "object_type", "name", F.col("classification.name").alias("class_name"))


def sanitize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sanitised(_shapes(spark, sf_dir)).select("slide_id", "ord", "id", "objectType", F.col("classification.name").alias("class_name"), F.col("geometry.type").alias("type"))


def export_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_errors(features(spark, sf_dir))


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feature_text(_shapes(spark, sf_dir))


def collection_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature lines as they are written, through the parser that reads collections."""
    lines = sinks.feature_text(_shapes(spark, sf_dir).where(F.col("type") == "Polygon"))
    read = sources.parsed_features(lines.select("slide_id", "ord", F.from_json("value", FEATURE_LINE).alias("f")))
    found = clean.shapes(read).select("slide_id", "ord", "id", "object_type", "class_name", F.posexplode(G.exterior(F.col("rings"))).alias("i", "p"))
    return found.select("slide_id", "ord", "id", "object_type", "class_name", "i", "p.x", "p.y")


def collection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections written slide by slide, and read again by splits."""
    path = f"{folder(spark)}/collections-{uuid.uuid4().hex}"
    sinks.write_features(_shapes(spark, sf_dir).where(F.col("type") == "Polygon"), path, collection=True)
    found = clean.shapes(sources.read_large_features(spark, path))
    rank = F.col("ord").cast("long").alias("place")
    return found.select(F.col("slide_id").cast("long").alias("slide_id"), rank, F.col("id").cast("long").alias("id"), "object_type", "class_name", F.posexplode(G.exterior(F.col("rings"))).alias("i", "p")).select("slide_id", "place", "id", "object_type", "class_name", "i", "p.x", "p.y")

def changed_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported features after two runs over files of slides, of which every other one has lost features between; and the run that wrote each."""
    top = f"{folder(spark)}/changes-{uuid.uuid4().hex}"
    shapes = settled(_shapes(spark, sf_dir).where(F.col("type") == "Polygon"), "shapes")
    wells = settled(slide_map(spark, sf_dir), "map")
    sinks.write_features(shapes, f"{top}/in", collection=True)
    jobs.collect_changed(spark, f"{top}/in", wells, f"{top}/out")
    sinks.write_features(shapes.where("slide_id % 2 = 0 AND ord % 3 <> 0"), f"{top}/in", collection=True, keep=True)
    report = jobs.collect_changed(spark, f"{top}/in", wells, f"{top}/out")
    found = spark.read.text(f"{top}/out/features").select(F.col("slide_id").cast("string").alias("slide_id"), F.get_json_object("value", "$.id").cast("long").alias("id"))
    again = found.select("slide_id").limit(0) if report is None else report.where(F.col("slide_id").isNotNull()).select("slide_id").distinct()
    run = F.coalesce("_run", F.lit(1)).alias("run")
    return found.join(again.withColumn("_run", F.lit(2)), "slide_id", "left").select(F.col("slide_id").cast("long").alias("slide_id"), "id", run)


# SQL

_F = """f AS (SELECT user_id % 8 AS slide_id, event_id AS ord, event_id AS id, CASE event_id % 10 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
  CASE WHEN event_id % 3 = 0 THEN 'detection' ELSE 'annotation' END AS object_type, CASE WHEN event_id % 10 = 0 THEN 'calib' || ((event_id // 10) % 5) END AS name,
  CASE WHEN event_id % 17 <> 0 THEN event_type END AS class_name, CAST(event_id * 37 % 1000 AS DOUBLE) AS cx, CAST(event_id * 91 % 1000 AS DOUBLE) AS cy, CAST(event_id % 20 + 5 AS DOUBLE) AS r FROM events)"""
_S = _F + """, s AS (SELECT * FROM f WHERE type IN ('Polygon', 'LineString') AND class_name IS NOT NULL)"""
_V = ", v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CORNERS)) + ") t(i, dx, dy))"
_CP = """, cp AS (SELECT slide_id, name, arg_max(cx, ord) AS x, arg_max(cy, ord) AS y, min(ord) AS first_ord FROM f WHERE type = 'Point' AND name IS NOT NULL AND name <> '' GROUP BY 1, 2)"""
_TRI = """, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY first_ord) AS pos FROM cp) WHERE pos <= 3),
tri AS (SELECT slide_id, max(x) FILTER (WHERE pos = 1) AS ax, max(y) FILTER (WHERE pos = 1) AS ay, max(x) FILTER (WHERE pos = 2) AS bx, max(y) FILTER (WHERE pos = 2) AS by_, max(x) FILTER (WHERE pos = 3) AS gx, max(y) FILTER (WHERE pos = 3) AS gy FROM sel GROUP BY 1 HAVING count(*) = 3)"""
_HIT = """, side AS (SELECT s.slide_id, s.ord, s.type, s.cx + s.r * p.dx AS x1, s.cy + s.r * p.dy AS y1, s.cx + s.r * q.dx AS x2, s.cy + s.r * q.dy AS y2 FROM s, v p JOIN v q ON q.i = p.i + 1),
tside AS (SELECT slide_id, ax AS x3, ay AS y3, bx AS x4, by_ AS y4 FROM tri UNION ALL SELECT slide_id, bx, by_, gx, gy FROM tri UNION ALL SELECT slide_id, gx, gy, ax, ay FROM tri),
o AS (SELECT e.*, t.*, (x4-x3)*(y1-y3)-(y4-y3)*(x1-x3) AS d1, (x4-x3)*(y2-y3)-(y4-y3)*(x2-x3) AS d2, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS d3, (x2-x1)*(y4-y1)-(y2-y1)*(x4-x1) AS d4 FROM side e JOIN tside t USING (slide_id)),
crossing AS (SELECT slide_id, ord, bool_or((d1*d2 < 0 AND d3*d4 < 0)
  OR (d1 = 0 AND x1 BETWEEN least(x3,x4) AND greatest(x3,x4) AND y1 BETWEEN least(y3,y4) AND greatest(y3,y4)) OR (d2 = 0 AND x2 BETWEEN least(x3,x4) AND greatest(x3,x4) AND y2 BETWEEN least(y3,y4) AND greatest(y3,y4))
  OR (d3 = 0 AND x3 BETWEEN least(x1,x2) AND greatest(x1,x2) AND y3 BETWEEN least(y1,y2) AND greatest(y1,y2)) OR (d4 = 0 AND x4 BETWEEN least(x1,x2) AND greatest(x1,x2) AND y4 BETWEEN least(y1,y2) AND greatest(y1,y2))) AS hit,
  (bool_or(type = 'Polygon')) AS poly FROM o GROUP BY 1, 2),
within AS (SELECT e.slide_id, e.ord, bool_or(area <> 0 AND ((a >= 0 AND b >= 0 AND c >= 0) OR (a <= 0 AND b <= 0 AND c <= 0))) AS hit FROM
  (SELECT e.slide_id, e.ord, (bx-ax)*(gy-ay)-(by_-ay)*(gx-ax) AS area, (bx-ax)*(y1-ay)-(by_-ay)*(x1-ax) AS a, (gx-bx)*(y1-by_)-(gy-by_)*(x1-bx) AS b, (ax-gx)*(y1-gy)-(ay-gy)*(x1-gx) AS c FROM side e JOIN tri USING (slide_id)) e GROUP BY 1, 2),
around AS (SELECT slide_id, ord, bool_or(n % 2 = 1) AS hit FROM (SELECT e.slide_id, e.ord, x3, y3, count(*) FILTER (WHERE (y1 > y3) <> (y2 > y3) AND ((y2 > y1 AND (x3-x1)*(y2-y1) < (x2-x1)*(y3-y1)) OR (y2 <= y1 AND (x3-x1)*(y2-y1) > (x2-x1)*(y3-y1)))) AS n FROM o e GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
hits AS (SELECT c.slide_id, c.ord, c.hit OR w.hit OR (c.poly AND a.hit) AS hit FROM crossing c JOIN within w USING (slide_id, ord) JOIN around a USING (slide_id, ord))"""
_COV = """, cov AS (SELECT t.slide_id, count(h.ord) AS shapes, count(*) FILTER (WHERE h.hit) AS hits FROM tri t LEFT JOIN hits h USING (slide_id) GROUP BY 1)"""


def _wells(source: str, key: str, plate_type: str, margin: str, row: str, col: str) -> str:
    """SQL of wells by key, with pos in plate order."""
    rows, cols = sources.check_plate(plate_type)
    return f"""(SELECT {key}, chr(CAST(64 + r AS INTEGER)) || c AS well, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx, row_number() OVER (PARTITION BY {key} ORDER BY r, c) AS pos
  FROM (SELECT k.{key}, r, c FROM (SELECT DISTINCT {key}, {margin} AS m, {row} AS sr, {col} AS sc FROM {source}) k, range(1, {rows + 1}) a(r), range(1, {cols + 1}) b(c)
    WHERE r BETWEEN 1 + m AND {rows} - m AND c BETWEEN 1 + m AND {cols} - m AND (r - 1 - m) % sr = 0 AND (c - 1 - m) % sc = 0))"""


_MAP = f""", map AS (SELECT c.class_name, w.well, c.n AS ord FROM (SELECT event_type AS class_name, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type < (SELECT max(event_type) FROM events))) c
  JOIN {_wells("(SELECT 1 AS one)", "one", "96", "2", "1", "1")} w ON w.pos = c.n)"""
_MAPPED = _MAP + """, mapped AS (SELECT s.*, m.well, row_number() OVER (PARTITION BY slide_id ORDER BY s.ord) AS shape_no FROM s JOIN map m USING (class_name))"""
_PTS = """, pts AS (SELECT slide_id, shape_no, well, i, CAST(floor((cx + r * dx) * 100) AS INTEGER) AS x, CAST(floor(-(cy + r * dy) * 100) AS INTEGER) AS y FROM mapped, v)"""


def _thinned(levels: int = 7) -> str:
    """SQL of kept(r, i): the octagon's points that stay at TOLERANCE; the sections of a level are split at once."""
    out = ", k0 AS (SELECT r, i FROM (SELECT DISTINCT r FROM s), (VALUES (0), (8)) t(i))"
    for n in range(1, levels + 1):
        out += f""", g{n} AS (SELECT r, i AS a, lead(i) OVER (PARTITION BY r ORDER BY i) AS b FROM k{n - 1}),
d{n} AS (SELECT r, a, b, i, sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) AS d FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE least(1, greatest(0, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t
  FROM (SELECT g.*, m.i, r * (m.dx - p.dx) AS px, r * (m.dy - p.dy) AS py, r * (q.dx - p.dx) AS dx, r * (q.dy - p.dy) AS dy FROM g{n} g JOIN v p ON p.i = g.a JOIN v q ON q.i = g.b JOIN v m ON m.i > g.a AND m.i < g.b))),
k{n} AS (SELECT r, i FROM k{n - 1} UNION SELECT r, arg_max(i, d - i * 1e-9) FROM d{n} GROUP BY r, a, b HAVING max(d) > {TOLERANCE})"""
    return out + f", kept AS (SELECT * FROM k{levels})"


_KEPT = _thinned()
_CUT = _KEPT + """, pts AS (SELECT slide_id, shape_no, well, row_number() OVER (PARTITION BY slide_id, shape_no ORDER BY i) - 1 AS i, CAST(floor((cx + r * dx) * 100) AS INTEGER) AS x, CAST(floor(-(cy + r * dy) * 100) AS INTEGER) AS y FROM mapped JOIN kept USING (r) JOIN v USING (i)),
sized AS (SELECT m.*, n.n AS points FROM mapped m JOIN (SELECT r, count(*) AS n FROM kept GROUP BY r) n USING (r))"""
_B = "b AS (SELECT DISTINCT p_size AS study, p_brand AS class_name FROM part)"
_C = "b AS (SELECT DISTINCT p_size % 4 AS study, p_brand || '_' || p_type AS class_name FROM part)"


def _assigned(wells: str, order: str = "pos") -> str:
    return f"""a AS (SELECT c.study, c.class_name, w.well, CAST(c.n AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY class_name) AS n FROM b) c
  JOIN (SELECT study, well, row_number() OVER (PARTITION BY study ORDER BY {order}) AS n FROM {wells}) w USING (study, n))"""


_STUDY = _wells("b", "study", "384", "1", "2", "2")
_TIGHT = _wells("b", "study", "96", "0", "1", "2")
_FULL = _wells("b", "study", "384", "0", "1", "1")
_MD5 = f"md5('{SEED}:' || well), well"
_GRID = f"""g AS (SELECT w.study, substr(w.well, 1, 1) AS row, w.col_idx, coalesce(a.class_name, '') AS class_name FROM {_FULL} w LEFT JOIN a USING (study, well))"""
_COLOR = "CASE CAST(pos % 6 AS INTEGER) WHEN 0 THEN -65536 WHEN 1 THEN -16711936 WHEN 2 THEN -16776961 WHEN 3 THEN -65281 WHEN 4 THEN -16711681 ELSE -256 END"
_COMBI = f"""combi AS (SELECT CAST(pos AS BIGINT) AS pos, class_name, CAST({_COLOR} AS INTEGER) AS color FROM (SELECT row_number() OVER (ORDER BY x, y, i) - 1 AS pos, x || '_' || y || '_' || i AS class_name
  FROM (SELECT DISTINCT p_brand AS x FROM part), (SELECT DISTINCT p_type AS y FROM part), range(1, 4) t(i)))"""
_NULL = "CAST(NULL AS VARCHAR)"

SQL: dict[str, str] = {
    "feature_census": f"WITH {_F} SELECT slide_id, type, count(*) AS n FROM f GROUP BY 1, 2",
    "census_report": f"WITH {_F} SELECT slide_id, string_agg(t, ', ' ORDER BY t) AS report FROM (SELECT slide_id, count(*) || ' ' || type || 's' AS t FROM f GROUP BY slide_id, type) GROUP BY 1",
    "clean_shapes": f"WITH {_S} SELECT slide_id, ord, type, class_name FROM s",
    "rejected_shapes": f"WITH {_F} SELECT slide_id, ord, id, type, class_name, 'several polygons in one feature: split them' AS reason FROM f WHERE type = 'MultiPolygon' AND class_name IS NOT NULL",
    "json_property_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "null_census": f"""WITH {_F} SELECT slide_id, 'id' AS "column", count(*) FILTER (WHERE id IS NULL) AS n FROM f GROUP BY 1 UNION ALL SELECT slide_id, 'name', count(*) FILTER (WHERE name IS NULL) FROM f GROUP BY 1
  UNION ALL SELECT slide_id, 'classification', count(*) FILTER (WHERE class_name IS NULL) FROM f GROUP BY 1 UNION ALL SELECT slide_id, 'rings', count(*) FILTER (WHERE type NOT IN ('Polygon', 'LineString')) FROM f GROUP BY 1""",
    "quality_report": f"""WITH {_S}{_V}{_CP}{_TRI}{_HIT}{_COV}{_MAP}, rep AS (
  SELECT slide_id, 'empty_input' AS c, 'info' AS severity, count(*) AS n, '' AS detail FROM f GROUP BY 1
  UNION ALL SELECT slide_id, 'no_names', CASE WHEN count(name) = 0 THEN 'error' ELSE 'info' END, count(name), '' FROM f GROUP BY 1
  UNION ALL SELECT slide_id, 'geometry', 'info', count(*), type FROM f GROUP BY slide_id, type
  UNION ALL SELECT slide_id, 'unclassified', CASE WHEN count(*) FILTER (WHERE type <> 'Point' AND class_name IS NULL) > 0 THEN 'warn' ELSE 'info' END, count(*) FILTER (WHERE type <> 'Point' AND class_name IS NULL), '' FROM f GROUP BY 1
  UNION ALL SELECT slide_id, 'rejected', 'warn', count(*), type FROM f WHERE type = 'MultiPolygon' AND class_name IS NOT NULL GROUP BY slide_id, type
  UNION ALL SELECT slide_id, 'coverage', CASE WHEN shapes = 0 OR hits < 0.25 * shapes THEN 'warn' ELSE 'info' END, hits, CASE WHEN shapes = 0 THEN 'no shapes' ELSE printf('%.2f%%', 100.0 * hits / shapes) END FROM cov
  UNION ALL SELECT slide_id, 'export_nulls', 'info', 0, c FROM (SELECT DISTINCT slide_id FROM s), (VALUES ('id'), ('objectType'), ('classification'), ('geometry')) t(c)
) SELECT CAST(slide_id AS VARCHAR) AS slide_id, c AS "check", severity, CAST(n AS BIGINT) AS n, detail FROM rep
UNION ALL SELECT {_NULL}, 'missing_class', 'warn', 1, class_name FROM (SELECT DISTINCT class_name FROM s) WHERE class_name NOT IN (SELECT class_name FROM map)
UNION ALL SELECT {_NULL}, 'capacity', CASE WHEN count(DISTINCT class_name) > 96 THEN 'warn' ELSE 'info' END, count(DISTINCT class_name), '96 wells' FROM s
UNION ALL SELECT CAST(slide_id AS VARCHAR), 'no_well', 'warn', count(*), class_name FROM s WHERE class_name NOT IN (SELECT class_name FROM map) GROUP BY slide_id, class_name""",
    "calibration_points": f"WITH {_F}{_CP} SELECT * FROM cp",
    "calibration_missing": f"WITH {_F}{_CP} SELECT x.slide_id, x.pos, x.name FROM (SELECT slide_id, pos, name FROM (SELECT DISTINCT slide_id FROM f), (VALUES (0, 'calib1'), (1, 'calib7'), (2, 'calib3')) t(pos, name)) x ANTI JOIN cp USING (slide_id, name)",
    "triangle_coverage": f"WITH {_S}{_V}{_CP}{_TRI}{_HIT}{_COV} SELECT slide_id, shapes, hits, round(hits / nullif(shapes, 0), 9) AS share, CASE WHEN shapes = 0 THEN 'no shapes' WHEN hits < 0.25 * shapes THEN 'low' ELSE 'ok' END AS status FROM cov",
    "triangle_hits": f"WITH {_S}{_V}{_CP}{_TRI}{_HIT} SELECT slide_id, ord, hit FROM hits",
    "closed_triangles": f"WITH {_F}{_CP}{_TRI} SELECT slide_id, CAST(i AS INTEGER) AS i, x, y FROM (SELECT slide_id, 0 AS i, ax AS x, ay AS y FROM tri UNION ALL SELECT slide_id, 1, bx, by_ FROM tri UNION ALL SELECT slide_id, 2, gx, gy FROM tri UNION ALL SELECT slide_id, 3, ax, ay FROM tri)",
    "file_stems": "SELECT event_id, 'slide.' || event_id || CASE WHEN event_id % 3 > 0 THEN '.' || event_type ELSE '' END AS stem FROM events",
    "acceptable_wells": f"WITH {_F} SELECT slide_id, well, row_idx, col_idx, CAST(pos AS INTEGER) AS pos FROM {_wells('f', 'slide_id', '384', 'slide_id % 3', 'slide_id % 2 + 1', 'slide_id % 3 + 1')}",
    "plate_grid": f"WITH {_F} SELECT slide_id, w.well, w.well AS cell, u.well IS NOT NULL AS available FROM {_wells('f', 'slide_id', '96', '0', '1', '1')} w LEFT JOIN {_wells('f', 'slide_id', '96', 'slide_id % 3', '1', '1')} u USING (slide_id, well)",
    "assign_wells": f"WITH {_B}, {_assigned(_STUDY)} SELECT * FROM a",
    "assign_wells_shuffled": f"WITH {_B}, {_assigned(_STUDY, _MD5)} SELECT * FROM a",
    "plate_overflow": f"WITH {_C} SELECT study, class_name FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY class_name) AS n FROM b) WHERE n > 48",
    "plate_capacity": f"WITH {_C} SELECT study, count(*) AS classes, CAST(48 AS BIGINT) AS wells, count(*) <= 48 AS fits FROM b GROUP BY 1",
    "plate_pivot": f"WITH {_B}, {_assigned(_STUDY, _MD5)}, {_GRID} SELECT study, row, " + ", ".join(f"max(class_name) FILTER (WHERE col_idx = {i}) AS \"{i}\"" for i in range(1, 25)) + " FROM g GROUP BY 1, 2",
    "plate_unpivot": f"WITH {_B}, {_assigned(_STUDY, _MD5)} SELECT study, class_name, well FROM a",
    "map_missing_classes": f"WITH {_S}{_MAP} SELECT DISTINCT class_name FROM s WHERE class_name NOT IN (SELECT class_name FROM map)",
    "map_invalid_wells": f"WITH {_C}, {_assigned(_FULL)} SELECT study, class_name, well FROM a WHERE substr(well, 1, 1) > 'H' OR CAST(substr(well, 2) AS INTEGER) > 12",
    "map_shared_wells": f"WITH {_C}, {_assigned(_FULL)} SELECT well, count(*) AS n, string_agg(class_name, ', ' ORDER BY class_name) AS classes FROM a GROUP BY 1 HAVING count(*) > 1",
    "map_json": f"""WITH {_B}, {_assigned(_STUDY)} SELECT study, '{{' || string_agg('"' || class_name || '":"' || well || '"', ',' ORDER BY ord) || '}}' AS value FROM a GROUP BY 1""",
    "map_text_parse": "SELECT p_partkey, 0 AS ord, p_brand AS class_name, 'A1' AS well FROM part UNION ALL SELECT p_partkey, 1, p_type, 'B2' FROM part",
    "list_items": "SELECT p_partkey, 0 AS pos, p_brand AS item FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part",
    "split_classes": f"""WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY ord) AS k, class_name IN ((SELECT min(class_name) FROM s), (SELECT max(class_name) FROM s)) AS listed FROM s)
  SELECT 0 AS slide_id, ord, class_name AS original_class_name, c AS class_name, c AS classification_name FROM (SELECT *, CASE WHEN listed THEN class_name || '_' || printf('%03d', k) ELSE class_name END AS c FROM n)""",
    "shape_wells": f"WITH {_S}{_MAPPED} SELECT slide_id, ord, class_name, well, CAST(shape_no AS INTEGER) AS shape_no FROM mapped",
    "shapes_without_wells": f"WITH {_S}{_MAP} SELECT slide_id, class_name, count(*) AS n FROM s WHERE class_name NOT IN (SELECT class_name FROM map) GROUP BY 1, 2",
    "shape_stats": f"""WITH {_S}{_V}{_MAPPED}{_CUT}, one AS (SELECT slide_id, shape_no, well, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1, 2, 3)
  SELECT slide_id, well, count(*) AS shapes, CAST(min(n) AS INTEGER) AS min_vertices, avg(n) AS mean_vertices, CAST(median(n) AS DOUBLE) AS median_vertices, CAST(max(n) AS INTEGER) AS max_vertices, min(x0) AS x_min, max(x1) AS x_max, min(y0) AS y_min, max(y1) AS y_max FROM one GROUP BY 1, 2""",
    "transform_coords": f"WITH {_S}{_V}{_MAPPED}{_PTS} SELECT slide_id, CAST(shape_no AS INTEGER) AS shape_no, i, x, y FROM pts",
    "simplify_outline": f"WITH {_S}{_V}{_KEPT} SELECT slide_id, ord, CAST(row_number() OVER (PARTITION BY slide_id, ord ORDER BY i) - 1 AS INTEGER) AS i, cx + r * dx AS x, cy + r * dy AS y FROM s JOIN kept USING (r) JOIN v USING (i)",
    "outline_crossings": f"""WITH w AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(WINDING, TWISTED, strict=True)))}) t(i, x, y, tx, ty)),
p AS (SELECT event_id AS ord, i, event_id * 37 % 1000 + CASE WHEN event_id % 4 = 3 THEN tx ELSE x END AS x, event_id * 91 % 1000 + CASE WHEN event_id % 4 = 3 THEN ty ELSE y END AS y FROM events, w),
e AS (SELECT ord, i, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM p WINDOW o AS (PARTITION BY ord ORDER BY i)),
q AS (SELECT a.ord, a.i, b.i AS j, a.x1, a.y1, a.x2, a.y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4 FROM e a JOIN e b ON a.ord = b.ord AND a.i < b.i WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL),
o AS (SELECT *, (x4-x3)*(y1-y3)-(y4-y3)*(x1-x3) AS d1, (x4-x3)*(y2-y3)-(y4-y3)*(x2-x3) AS d2, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS d3, (x2-x1)*(y4-y1)-(y2-y1)*(x4-x1) AS d4 FROM q),
c AS (SELECT ord, count(*) FILTER (WHERE j - i NOT IN (1, {len(WINDING) - 2}) AND ((d1 * d2 < 0 AND d3 * d4 < 0)
  OR (d1 = 0 AND x1 BETWEEN least(x3,x4) AND greatest(x3,x4) AND y1 BETWEEN least(y3,y4) AND greatest(y3,y4)) OR (d2 = 0 AND x2 BETWEEN least(x3,x4) AND greatest(x3,x4) AND y2 BETWEEN least(y3,y4) AND greatest(y3,y4))
  OR (d3 = 0 AND x3 BETWEEN least(x1,x2) AND greatest(x1,x2) AND y3 BETWEEN least(y1,y2) AND greatest(y1,y2)) OR (d4 = 0 AND x4 BETWEEN least(x1,x2) AND greatest(x1,x2) AND y4 BETWEEN least(y1,y2) AND greatest(y1,y2)))) AS n FROM o GROUP BY 1)
SELECT ord, CAST(n AS INTEGER) AS before, CASE WHEN n = 0 THEN 0 END AS after FROM c""",
    "collection_xml_lines": f"""WITH {_S}{_V}{_CP}{_TRI}{_MAPPED}{_CUT}, t AS (SELECT slide_id, count(*) AS n FROM mapped GROUP BY 1),
head AS (SELECT slide_id, unnest(['<?xml version=''1.0'' encoding=''UTF-8''?>', '<ImageData>', '  <GlobalCoordinates>1</GlobalCoordinates>']
   || list_transform([[1, ax, ay], [2, bx, by_], [3, gx, gy]], lambda p: '  <X_CalibrationPoint_' || CAST(p[1] AS INTEGER) || '>' || CAST(floor(p[2] * 100) AS INTEGER) || '</X_CalibrationPoint_' || CAST(p[1] AS INTEGER) || '>' || chr(10) || '  <Y_CalibrationPoint_' || CAST(p[1] AS INTEGER) || '>' || CAST(floor(-p[3] * 100) AS INTEGER) || '</Y_CalibrationPoint_' || CAST(p[1] AS INTEGER) || '>')
   || ['  <ShapeCount>' || n || '</ShapeCount>']) AS s FROM tri JOIN t USING (slide_id)),
lines AS (SELECT slide_id, 0 AS shape_no, l.i - 1 AS line_no, l.s FROM (SELECT slide_id, string_split(string_agg(s, chr(10)), chr(10)) AS a FROM head GROUP BY 1) h, LATERAL (SELECT unnest(h.a) AS s, unnest(range(1, len(h.a) + 1)) AS i) l
  UNION ALL SELECT slide_id, shape_no, 0, '  <Shape_' || shape_no || '>' FROM mapped UNION ALL SELECT slide_id, shape_no, 1, '    <PointCount>' || points || '</PointCount>' FROM sized UNION ALL SELECT slide_id, shape_no, 2, '    <CapID>' || well || '</CapID>' FROM mapped
  UNION ALL SELECT slide_id, shape_no, 3 + 2 * i, '    <X_' || (i + 1) || '>' || x || '</X_' || (i + 1) || '>' FROM pts UNION ALL SELECT slide_id, shape_no, 4 + 2 * i, '    <Y_' || (i + 1) || '>' || y || '</Y_' || (i + 1) || '>' FROM pts
  UNION ALL SELECT slide_id, shape_no, 3 + 2 * points, '  </Shape_' || shape_no || '>' FROM sized UNION ALL SELECT slide_id, 4611686018427387904, 0, '</ImageData>' FROM t)
SELECT slide_id, CAST(shape_no AS BIGINT) AS shape_no, CAST(line_no AS INTEGER) AS line_no, s FROM lines SEMI JOIN tri USING (slide_id)""",
    "combinations_palette": f"WITH {_COMBI} SELECT * FROM combi",
    "palette_json": f"""WITH {_COMBI} SELECT '{{"pathClasses":[' || string_agg('{{"name":"' || class_name || '","color":' || color || '}}', ',' ORDER BY pos) || ']}}' AS value FROM combi""",
    "colour_round_trip": "SELECT p_partkey, CAST(r * 65536 + g * 256 + b - 16777216 AS INTEGER) AS color, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)",
    "sample_in_region": f"""WITH {_F}{_V}, d AS (SELECT * FROM f WHERE type = 'Polygon' AND object_type = 'detection'), a AS (SELECT * FROM f WHERE type = 'Polygon' AND object_type = 'annotation'),
pairs AS (SELECT d.slide_id, a.id AS annotation_id, d.id, d.cx AS px, d.cy AS py, a.cx, a.cy, a.r FROM d JOIN a ON a.slide_id = d.slide_id AND abs(d.cx - a.cx) <= a.r AND abs(d.cy - a.cy) <= a.r),
ins AS (SELECT slide_id, annotation_id, id FROM (SELECT slide_id, annotation_id, id, px, py, cx + r * p.dx AS x1, cy + r * p.dy AS y1, cx + r * q.dx AS x2, cy + r * q.dy AS y2 FROM pairs, v p JOIN v q ON q.i = p.i + 1)
  GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND ((y2 > y1 AND (px-x1)*(y2-y1) < (x2-x1)*(py-y1)) OR (y2 <= y1 AND (px-x1)*(y2-y1) > (x2-x1)*(py-y1)))) % 2 = 1)
SELECT slide_id, annotation_id, id, row_number() OVER (PARTITION BY slide_id, annotation_id ORDER BY md5('{SEED}:' || id), id) <= 1 AS selected FROM ins""",
    "convert_detections": f"WITH {_F} SELECT slide_id, ord, CASE WHEN ord % 2 = 0 THEN 'annotation' ELSE object_type END AS object_type, CASE WHEN ord % 2 = 0 AND object_type = 'detection' THEN NULL ELSE name END AS name, class_name FROM f",
    "sanitize_features": f"""WITH {_S} SELECT slide_id, ord, id, object_type AS "objectType", class_name, type FROM s""",
    "export_errors": f"""WITH {_F} SELECT slide_id, 'classification' AS "column", count(*) AS n FROM f WHERE class_name IS NULL GROUP BY 1""",
    "collection_read": f"WITH {_S}{_V} SELECT slide_id, ord, CAST(id AS VARCHAR) AS id, object_type, class_name, i, cx + r * dx AS x, cy + r * dy AS y FROM s, v WHERE type = 'Polygon'",
    "collection_files": f"""WITH {_S}{_V}, c AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY ord) - 1 AS place FROM s WHERE type = 'Polygon')
  SELECT slide_id, place, id, object_type, class_name, i, cx + r * dx AS x, cy + r * dy AS y FROM c, v""",
    "changed_slides": f"WITH {_S} SELECT slide_id, id, CAST(CASE WHEN slide_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS run FROM s WHERE type = 'Polygon' AND (slide_id % 2 = 1 OR ord % 3 <> 0)",
    "feature_lines": f"""WITH {_S}{_V} SELECT slide_id, ord, '{{"type":"Feature","id":' || id || ',"geometry":{{"type":"' || type || '","coordinates":[[' || string_agg('[' || (cx + r * dx) || ',' || (cy + r * dy) || ']', ',' ORDER BY i) || ']]}},"properties":{{"objectType":"' || object_type || '","classification":{{"name":"' || class_name || '","color":[3,128,17]}}}}}}' AS value
  FROM s, v GROUP BY slide_id, ord, id, type, object_type, class_name""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        shape_wells, feature_census, census_report, clean_shapes, rejected_shapes, json_property_extract, null_census, quality_report, calibration_points, calibration_missing, triangle_coverage, triangle_hits, closed_triangles, file_stems,
        acceptable_wells, plate_grid, assign_wells, assign_wells_shuffled, plate_overflow, plate_capacity, plate_pivot, plate_unpivot, map_missing_classes, map_invalid_wells, map_shared_wells, map_json, map_text_parse,
        list_items, split_classes, shapes_without_wells, shape_stats, transform_coords, simplify_outline, outline_crossings, collection_xml_lines, combinations_palette, palette_json, colour_round_trip, sample_in_region, convert_detections,
        sanitize_features, export_errors, feature_lines, collection_read, collection_files, changed_slides,
    )
}
