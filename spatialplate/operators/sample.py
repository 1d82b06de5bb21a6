"""Detections inside annotations, random samples of them, and their conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..staging import settled

#: Pixels of a finest cell, the levels of cells (each has sides of 2^level finest ones), and what a cell may hold before it is split.
CELL, LEVELS, LOAD = 32.0, (0, 2, 4, 6, 8, 10, 12), 128
STEP, TOP = LEVELS[1], LEVELS[-1]


def _fine(v: Column | str) -> Column:
    return F.floor(F.col(v) / CELL if isinstance(v, str) else v / CELL)


def _above(c: str, levels: str) -> Column:
    """A cell's place among cells so many levels up."""
    return F.expr(f"shiftright({c}, {levels})")


def leaves(points: DataFrame, load: int = LOAD) -> DataFrame:
    """(slide_id, cx, cy, leaf): for each finest cell that holds some of points(slide_id, cx, cy), the level of the cell that it belongs to.

    Cells are split while they hold more than `load` points, so that a crowded
    place has small cells and an empty one large ones. Points are counted by
    finest cell first; only these counts go up through the levels.
    """
    counts = settled(points.groupBy("slide_id", "cx", "cy").agg(F.count("*").alias("n")), "counts")
    ladder = counts.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS[1:])))).withColumns({"px": _above("cx", "level"), "py": _above("cy", "level")})
    crowded = ladder.groupBy("slide_id", "level", "px", "py").agg(F.sum("n").alias("held")).where(F.col("held") > load).drop("held")
    lowest = ladder.join(crowded, ["slide_id", "level", "px", "py"], "left_semi").groupBy("slide_id", "cx", "cy").agg(F.min("level").alias("low"))
    return counts.join(lowest, ["slide_id", "cx", "cy"], "left").select("slide_id", "cx", "cy", F.coalesce(F.col("low") - STEP, F.lit(TOP)).alias("leaf"))


def _pieces(areas: DataFrame, cells: DataFrame) -> DataFrame:
    """(slide_id, leaf, lx, ly, annotation_id, whole, edges, box): annotations by the leaves that they cover in part or whole.

    An annotation is laid on the cells of its own size and on larger ones, four
    a level at most up to the top; a leaf on itself and all above. The two meet
    on the annotation's own level where the leaf is smaller, else on the leaf's.
    A leaf that no side reaches lies inside or outside as its centre does; of
    the others go the sides that a ray to the right from the leaf may meet.
    """
    size = lambda level: F.pow(F.lit(2.0), level) * F.lit(CELL)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(CELL))
    own = F.least(F.ceil(F.log2(span / CELL) / STEP).cast("int") * STEP, F.lit(TOP)).alias("own")
    graded = areas.select("slide_id", "annotation_id", "x0", "y0", "x1", "y1", own).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda v: v >= F.col("own"))))
    cells_of = lambda low, high: F.sequence(F.floor(F.col(low) / size(F.col("level"))), F.floor(F.col(high) / size(F.col("level"))))
    laid = graded.withColumn("px", F.explode(cells_of("x0", "x1"))).withColumn("py", F.explode(cells_of("y0", "y1")))
    found = cells.select("slide_id", "leaf", _above("cx", "leaf").alias("lx"), _above("cy", "leaf").alias("ly")).distinct()
    raised = found.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda v: v >= F.col("leaf"))))
    raised = raised.withColumns({"px": _above("lx", "level - leaf"), "py": _above("ly", "level - leaf")})
    at_own = laid.where(F.col("level") == F.col("own")).join(raised, ["slide_id", "level", "px", "py"])
    above = laid.where(F.col("level") > F.col("own")).join(found.select("slide_id", "leaf", "lx", "ly", F.col("leaf").alias("level"), F.col("lx").alias("px"), F.col("ly").alias("py")), ["slide_id", "level", "px", "py"])
    met = at_own.unionByName(above)
    side = size(F.col("leaf"))
    corner = {"bx0": F.col("lx") * side, "by0": F.col("ly") * side, "bx1": (F.col("lx") + 1) * side, "by1": (F.col("ly") + 1) * side}
    near = met.withColumns(corner).where((F.col("bx1") >= F.col("x0")) & (F.col("bx0") <= F.col("x1")) & (F.col("by1") >= F.col("y0")) & (F.col("by0") <= F.col("y1")))
    near = near.select("slide_id", "leaf", "lx", "ly", "annotation_id", *corner)
    # A large annotation has many leaves, each of which takes some of its sides.
    shaped = near.join(areas.select("slide_id", "annotation_id", "edges", "x0", "y0", "x1", "y1"), ["slide_id", "annotation_id"])
    ray = F.filter("edges", lambda e: (F.greatest(e.a.y, e.b.y) >= F.col("by0")) & (F.least(e.a.y, e.b.y) <= F.col("by1")) & (F.greatest(e.a.x, e.b.x) >= F.col("bx0")))
    judged = shaped.select("slide_id", "leaf", "lx", "ly", "annotation_id", *corner, "x0", "y0", "x1", "y1", F.inline(F.transform(F.array(ray), lambda r: F.struct(r.alias("edges"), (~F.exists(r, lambda e: F.least(e.a.x, e.b.x) <= F.col("bx1"))).alias("whole")))))
    centre = F.struct(((F.col("bx0") + F.col("bx1")) / 2).alias("x"), ((F.col("by0") + F.col("by1")) / 2).alias("y"))
    kept = judged.where(~F.col("whole") | G.within(centre, F.col("edges")))
    return kept.select("slide_id", "leaf", "lx", "ly", "annotation_id", "whole", F.when(~F.col("whole"), F.col("edges")).alias("edges"), "x0", "y0", "x1", "y1")


def _laid(detections: DataFrame, annotations: DataFrame, load: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """spots(slide_id, id, x, y), areas(slide_id, annotation_id, shape) and met(slide_id, shape, x, y): places of detections in outlines of annotations.

    Detections at one place, and annotations of one outline, go through the
    tests once: met has a row for each outline and place, not for each pair.
    """
    # Rows come out of generators, so that geometry is worked out once a row and filters come after it.
    point = lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))
    spots = detections.where(F.col("slide_id").isNotNull() & F.col("id").isNotNull()).select("slide_id", "id", F.inline(F.transform(F.array(G.centroid(F.col("rings"))), point)))
    spots = settled(spots.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "spots")
    whole = lambda b: F.struct(G.edges(F.col("rings")).alias("edges"), b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"))
    areas = annotations.where(F.col("slide_id").isNotNull() & F.col("id").isNotNull()).select("slide_id", F.col("id").alias("annotation_id"), F.inline(F.transform(F.array(G.box(F.col("rings"))), whole)))
    areas = settled(areas.where(F.col("x0").isNotNull()).withColumn("shape", F.sha2(F.col("edges").cast("string"), 256)), "areas")
    places = settled(spots.select("slide_id", "x", "y", _fine("x").alias("cx"), _fine("y").alias("cy")).distinct(), "places")
    outlines = areas.groupBy("slide_id", F.col("shape").alias("annotation_id")).agg(*[F.any_value(c).alias(c) for c in ("edges", "x0", "y0", "x1", "y1")])
    outlines = settled(outlines, "outlines")
    centres = outlines.select("slide_id", _fine((F.col("x0") + F.col("x1")) / 2).alias("cx"), _fine((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    cells = settled(leaves(places.select("slide_id", "cx", "cy").unionByName(centres), load), "leaves")
    placed = places.join(cells, ["slide_id", "cx", "cy"]).select("slide_id", "leaf", _above("cx", "leaf").alias("lx"), _above("cy", "leaf").alias("ly"), "x", "y")
    near = placed.join(settled(_pieces(outlines, cells), "pieces"), ["slide_id", "leaf", "lx", "ly"])
    boxed = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    met = near.where(F.col("whole") | (boxed & G.within(F.struct("x", "y"), F.col("edges")))).select("slide_id", F.col("annotation_id").alias("shape"), "x", "y")
    return spots, areas.select("slide_id", "annotation_id", "shape"), met


def inside(detections: DataFrame, annotations: DataFrame, load: int = LOAD) -> DataFrame:
    """(slide_id, annotation_id, id): detections whose centroid lies in an annotation.

    Both are dealt out by the leaves of a quadtree a slide, split by what they
    hold, so that a place with all of a slide's detections, or an annotation of
    the slide's size, is many keys of like weight. In a leaf that lies inside an
    annotation no point is tested. Rows without a slide, an id or points take no
    part; an annotation's id is its own within its slide.
    """
    spots, areas, met = _laid(detections, annotations, load)
    return met.join(areas, ["slide_id", "shape"]).join(spots, ["slide_id", "x", "y"]).select("slide_id", "annotation_id", "id")


def _mixed(id_: str, seed: int) -> Column:
    """The seed's order of ids."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string"))).alias("h"), id_)


def _least(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows of least _mix of each of the keys' values, picked by each task first."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_mix"))).where(F.col("_n") <= n).drop("_n")


def sampled_inside(detections: DataFrame, annotations: DataFrame, n: int, seed: int, load: int = LOAD) -> DataFrame:
    """sampled(inside(...)), for which no pair of an annotation and a detection is written or sent.

    Annotations of one outline have the same bound, found from the n least
    detections of each place in it; pairs come up in the last join only.
    """
    spots, areas, met = _laid(detections, annotations, load)
    spots = spots.withColumn("_mix", _mixed("id", seed))
    first = met.join(_least(spots.select("slide_id", "x", "y", "_mix"), n, "slide_id", "x", "y"), ["slide_id", "x", "y"]).select("slide_id", "shape", "_mix")
    bound = _least(first, n, "slide_id", "shape").groupBy("slide_id", "shape").agg(F.max("_mix").alias("_bound"))
    members = areas.join(bound, ["slide_id", "shape"], "left")
    pairs = met.join(members, ["slide_id", "shape"]).join(spots, ["slide_id", "x", "y"])
    return pairs.select("slide_id", "annotation_id", "id", F.coalesce(F.col("_mix") <= F.col("_bound"), F.lit(False)).alias("selected"))


def sampled(found: DataFrame, n: int, seed: int) -> DataFrame:
    """found with `selected`: n of each annotation's detections, or all if it has fewer, by the seed's order.

    Each task picks its own n first, so that no more than these of an annotation
    come together; the last of all that are picked is the bound for the rest.
    found is written once; see sampled_inside() for pairs that are too many.
    """
    mixed = settled(found.withColumn("_mix", _mixed("id", seed)), "found")
    keys = ["slide_id", "annotation_id"]
    bound = _least(mixed.select(*keys, "_mix"), n, *keys).groupBy(*keys).agg(F.max("_mix").alias("_bound"))
    return mixed.join(bound, keys, "left").select(*found.columns, F.coalesce(F.col("_mix") <= F.col("_bound"), F.lit(False)).alias("selected"))


def converted(features: DataFrame) -> DataFrame:
    """features(object_type, selected, ...): selected detections become annotations, with a new id and without a name, after all that stay."""
    picked = F.coalesce(F.col("selected"), F.lit(False)) & (F.col("object_type") == "detection")
    new = features.where(picked).withColumn("object_type", F.lit("annotation")).withColumn("id", F.uuid())
    if "name" in features.columns:
        new = new.withColumn("name", F.lit(None).cast("string"))
    return features.where(~F.coalesce(picked, F.lit(False))).unionByName(new)
