"""Shapes with wells and whole-number outlines, ready to be cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .numbering import numbered

#: The place of a job's last line, after those of all shapes.
LAST = 1 << 62


def with_wells(shapes: DataFrame, class_wells: DataFrame, keys: tuple[str, ...] = (), stored: bool = False) -> DataFrame:
    """shapes whose class has a well, with `well` and shape_no: 1, 2, ... in each slide's file order.

    Maps are joined as their size suggests; a slide may have any number of
    shapes. With `stored` the shapes come from a table of sinks.store_features(),
    and each slide is numbered where it lies.
    """
    mapped = shapes.join(class_wells.select(*keys, "class_name", "well"), [*keys, "class_name"])
    if stored:
        return mapped.withColumn("shape_no", F.row_number().over(W.partitionBy("slide_id").orderBy("ord")))
    return numbered(mapped, "shape_no", ("slide_id",))


def without_wells(shapes: DataFrame, class_wells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(slide_id, class_name, n): shapes that no well is for."""
    right = class_wells.select(*keys, "class_name").distinct()
    return shapes.join(right, [*keys, "class_name"], "left_anti").groupBy("slide_id", "class_name").agg(F.count("*").alias("n"))


def outlines(mapped: DataFrame, tolerance: float | None = 1.0, factor: float = 100.0) -> DataFrame:
    """(slide_id, shape_no, well, pts): exteriors, simplified unless tolerance is None, turned to the instrument's axes and scaled."""
    rings = F.col("rings") if tolerance is None else G.simplified(F.col("rings"), tolerance)
    cut = mapped.select("slide_id", "shape_no", "well", G.exterior(rings).alias("_ring"))
    return cut.select("slide_id", "shape_no", "well", F.transform("_ring", lambda p: G.scaled(G.oriented(p), factor)).alias("pts"))


def statistics(outlined: DataFrame) -> DataFrame:
    """By slide and well: shapes, vertices (least, mean, median, most) and the bounding box.

    Shapes are counted by their number of vertices first; the median is picked
    from these counts, so that no state holds a value for each shape.
    """
    xs, ys = F.transform("pts", lambda p: p.x), F.transform("pts", lambda p: p.y)
    rows = outlined.select("slide_id", "well", F.size("pts").alias("n"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    sizes = rows.groupBy("slide_id", "well", "n").agg(F.count("*").alias("shapes"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    group = W.partitionBy("slide_id", "well")
    upto = sizes.withColumn("upto", F.sum("shapes").over(group.orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("all", F.sum("shapes").over(group))
    middle = lambda at: F.min(F.when(F.col("upto") >= at, F.col("n")))
    return upto.groupBy("slide_id", "well").agg(
        F.sum("shapes").alias("shapes"), F.min("n").alias("min_vertices"), (F.sum(F.col("shapes") * F.col("n")) / F.sum("shapes")).alias("mean_vertices"),
        ((middle(F.floor((F.col("all") + 1) / 2)) + middle(F.floor(F.col("all") / 2) + 1)) / 2).alias("median_vertices"), F.max("n").alias("max_vertices"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"),
    )


def xml_lines(outlined: DataFrame, triangles: DataFrame, factor: float = 100.0) -> DataFrame:
    """(slide_id, shape_no, line_no, s): a cutting job's lines, in order within a slide; slides without a triangle or shapes have none.

    Lines are rows, so a slide of any size is never one value; nothing is gathered but a shape's own points.
    """
    one = lambda name, value, indent: F.concat(F.lit(" " * indent + "<"), name, F.lit(">"), value.cast("string"), F.lit("</"), name, F.lit(">"))
    text = F.lit
    both = outlined.join(F.broadcast(triangles.select("slide_id")), "slide_id", "left_semi")
    counts = both.groupBy("slide_id").agg(F.count("*").alias("n"))
    points = F.transform("points", lambda p: G.scaled(G.oriented(p), factor))
    head = counts.join(triangles, "slide_id").withColumn("points", points)
    head_lines = F.concat(
        F.array(text("<?xml version='1.0' encoding='UTF-8'?>"), text("<ImageData>"), text("  <GlobalCoordinates>1</GlobalCoordinates>")),
        F.flatten(F.transform("points", lambda p, i: F.array(one(F.concat(text("X_CalibrationPoint_"), (i + 1).cast("string")), p.x, 2), one(F.concat(text("Y_CalibrationPoint_"), (i + 1).cast("string")), p.y, 2)))),
        F.array(one(text("ShapeCount"), F.col("n"), 2)),
    )
    placed = lambda at, no, s: F.struct(F.lit(at).cast("long").alias("shape_no"), no.cast("int").alias("line_no"), s.alias("s"))
    around = F.concat(F.transform(head_lines, lambda s, i: placed(0, i, s)), F.array(placed(LAST, F.lit(0), text("</ImageData>"))))
    number = F.col("shape_no").cast("string")
    shape_lines = F.concat(
        F.array(F.concat(text("  <Shape_"), number, text(">")), one(text("PointCount"), F.size("pts"), 4), one(text("CapID"), F.col("well"), 4)),
        F.flatten(F.transform("pts", lambda p, i: F.array(one(F.concat(text("X_"), (i + 1).cast("string")), p.x, 4), one(F.concat(text("Y_"), (i + 1).cast("string")), p.y, 4)))),
        F.array(F.concat(text("  </Shape_"), number, text(">"))),
    )
    order = F.col("shape_no").cast("long").alias("shape_no")
    frame = head.select("slide_id", F.explode(around).alias("l")).select("slide_id", "l.shape_no", "l.line_no", "l.s")
    return frame.unionByName(both.select("slide_id", order, F.posexplode(shape_lines).alias("line_no", "s")))
