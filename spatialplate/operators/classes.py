"""Splitting classes into replicates, combining class names, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .numbering import numbered


def split_classes(shapes: DataFrame, classes: DataFrame | list[str]) -> DataFrame:
    """shapes whose listed classes are numbered in file order, from 1 in each slide; the name before is kept.

    Numbers follow the original name, so splitting again changes nothing.
    `classes` is a list, or a table with original_class_name.
    """
    original = F.coalesce("original_class_name", "class_name") if "original_class_name" in shapes.columns else F.col("class_name")
    named = shapes.withColumn("original_class_name", original)
    if isinstance(classes, list):
        listed = named.withColumn("_listed", F.coalesce(F.col("original_class_name").isin(classes), F.lit(False)))
    else:
        marks = classes.select("original_class_name").distinct().withColumn("_listed", F.lit(True))
        listed = named.join(marks, "original_class_name", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    counted = numbered(listed, "_n", ("slide_id", "original_class_name"))
    return counted.withColumn("class_name", F.when(F.col("_listed"), N.numbered_class(F.col("original_class_name"), F.col("_n"))).otherwise(F.col("class_name"))).drop("_listed", "_n")


def renamed_classification(shapes: DataFrame) -> DataFrame:
    """The classification's name taken from class_name."""
    return shapes.withColumn("classification", F.col("classification").withField("name", F.col("class_name")))


def combinations(first: DataFrame, second: DataFrame, replicates: int) -> DataFrame:
    """(pos, class_name, color): every item of first(pos, item) with every item of second and each number up to `replicates`, in that order, with the palette in rotation.

    Both lists are typed in by a person, so their product is small; positions
    are computed and not numbered by a window.
    """
    if not isinstance(replicates, int) or isinstance(replicates, bool) or replicates < 1:
        raise ValueError("replicates must be a positive whole number")
    a, b = first.select(F.col("pos").alias("_a"), F.col("item").alias("_x")), second.select(F.col("pos").alias("_b"), F.col("item").alias("_y"))
    size = b.agg(F.count("*").alias("_m"))
    out = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(size)).select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_i"))
    pos = ((F.col("_a") * F.col("_m") + F.col("_b")) * replicates + F.col("_i") - 1).cast("long")
    return out.select(pos.alias("pos"), N.combined_class(F.col("_x"), F.col("_y"), F.col("_i")).alias("class_name"), N.palette_colour(pos).alias("color"))
