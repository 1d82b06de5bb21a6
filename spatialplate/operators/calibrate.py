"""The calibration triangle and how many shapes it meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N

#: Below this share of shapes a slide gets a warning.
LEAST_SHARE = 0.25


def default_selection(calibration: DataFrame) -> DataFrame:
    """(slide_id, pos, name): the first three names of each slide in file order."""
    pos = F.row_number().over(W.partitionBy("slide_id").orderBy("first_ord"))
    return calibration.select("slide_id", pos.alias("pos"), "name").where(F.col("pos") <= 3)


def missing(selection: DataFrame, calibration: DataFrame) -> DataFrame:
    """Chosen names that their slide does not have."""
    return selection.join(calibration, ["slide_id", "name"], "left_anti")


def triangles(selection: DataFrame, calibration: DataFrame) -> DataFrame:
    """(slide_id, points): the three chosen points in their order, for slides that have them all."""
    places = selection.join(calibration.select("slide_id", "name", "x", "y"), ["slide_id", "name"])
    out = places.groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return out.where(F.size("p") == 3).select("slide_id", F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))).alias("points"))


def hits(shapes: DataFrame, triangles_: DataFrame) -> DataFrame:
    """shapes with `hit`: whether they meet the closed triangle of their slide.

    One row of three points a slide on the right side, which is broadcast:
    shapes stay where they were read, however few slides hold them.
    """
    corner = [F.get("points", F.lit(i)) for i in range(3)]
    rings = F.col("rings")
    ready = shapes.withColumn("_edges", G.edges(rings)).withColumn("_box", G.box(rings)).join(F.broadcast(triangles_), "slide_id")
    return ready.withColumn("hit", G.meets_triangle(F.col("type"), rings, *corner, F.col("_edges"), F.col("_box"))).drop("points", "_edges", "_box")


def coverage(shapes: DataFrame, triangles_: DataFrame) -> DataFrame:
    """(slide_id, shapes, hits, share, status, report) for each slide with a triangle."""
    counted = hits(shapes, triangles_).groupBy("slide_id").agg(F.count("*").alias("shapes"), F.count_if("hit").alias("hits"))
    all_slides = triangles_.select("slide_id").join(counted, "slide_id", "left").na.fill(0, ["shapes", "hits"])
    share = F.col("hits") / F.nullif(F.col("shapes"), F.lit(0))
    status = F.when(F.col("shapes") == 0, "no shapes").when(share < LEAST_SHARE, "low").otherwise("ok")
    return all_slides.select("slide_id", "shapes", "hits", share.alias("share"), status.alias("status"), N.percent(share).alias("report"))
