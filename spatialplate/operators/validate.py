"""Checks of maps and data, gathered in one report (slide_id, check, severity, n, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPORTED
from ..sources import check_plate, wells
from ..staging import settled
from . import calibrate, clean

REPORT = ("slide_id", "check", "severity", "n", "detail")


def missing_classes(shapes: DataFrame, class_wells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Classes of the data that the map does not have."""
    return shapes.where(F.col("class_name").isNotNull()).select(*keys, "class_name").distinct().join(class_wells, [*keys, "class_name"], "left_anti")


def invalid_wells(class_wells: DataFrame, plate: str = "384") -> DataFrame:
    """Map rows whose well is not on the plate. The check is against 384 wells unless another plate is given."""
    one = class_wells.sparkSession.range(1)
    return class_wells.join(F.broadcast(wells(one, plate).select("well")), "well", "left_anti")


def shared_wells(class_wells: DataFrame) -> DataFrame:
    """(well, n, classes) of wells that several classes have."""
    return class_wells.groupBy("well").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("class_name")), ", ").alias("classes")).where(F.col("n") > 1)


def checked_map(mapping: object) -> dict[str, str]:
    """A map given in code: a dict that is not empty, of strings."""
    if not isinstance(mapping, dict):
        raise ValueError("the map of classes to wells must be a dict")
    if not mapping:
        raise ValueError("the map of classes to wells is empty")
    if not all(isinstance(x, str) for kv in mapping.items() for x in kv):
        raise ValueError("classes and wells must be text")
    return mapping


def _row(df: DataFrame, check: str, severity: Column | str, n: Column, detail: Column | str = "") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.col("slide_id").cast("string").alias("slide_id"), F.lit(check).alias("check"), text(severity).alias("severity"), n.cast("long").alias("n"), text(detail).cast("string").alias("detail"))


def _when(bad: Column, severity: str) -> Column:
    return F.when(bad, severity).otherwise("info")


def tally(features: DataFrame) -> DataFrame:
    """What the checks count, in one pass over the features: a row for each slide, type, class, and name of a point.

    n rows; `named` with a name; no_... without that property; last: the greatest ord with its point; first_ord.
    """
    point = F.col("type") == "Point"
    keys = [
        "slide_id", "type", F.col("classification").isNotNull().alias("classified"), F.when(F.col("type") != "Point", F.col("classification.name")).alias("class_name"),
        F.when(point & (F.col("name") != ""), F.col("name")).alias("point_name"),
    ]
    counts = [F.count_if(F.col(c).isNull()).alias(f"no_{a}") for c, a in (("id", "id"), ("object_type", "objectType"), ("geometry", "geometry"))]
    return settled(features.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("name").isNotNull()).alias("named"), *counts, F.max(F.when(point, F.struct("ord", "point"))).alias("last"), F.min("ord").alias("first_ord")), "tally")


def quality_report(features: DataFrame, slides: DataFrame, class_wells: DataFrame | None = None, selection: DataFrame | None = None, plate: str = "384", usable: DataFrame | None = None) -> DataFrame:
    """All guards over all slides; `slides` lists those expected, and a well map and a choice of points add their checks.

    Room is that of the wells in `usable`(well), or of the whole plate. Features
    are read twice: for the tally, which all counts come from, and for coverage.
    """
    counted = tally(features)
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"))
    classified = counted.where((F.col("type") != "Point") & F.col("classified"))
    cuttable = F.coalesce(F.col("type").isin(*clean.CUTTABLE), F.lit(False))
    shapes = classified.where(cuttable)
    last = counted.where(F.col("point_name").isNotNull()).groupBy("slide_id", F.col("point_name").alias("name")).agg(F.max("last").alias("last"), F.min("first_ord").alias("first_ord"))
    points = last.select("slide_id", "name", F.col("last.point.x").alias("x"), F.col("last.point.y").alias("y"), "first_ord")
    counts = slides.select("slide_id").distinct().join(counted.groupBy("slide_id").agg(F.sum("n").alias("n"), F.sum("named").alias("named")), "slide_id", "left").na.fill(0, ["n", "named"])
    bare = counted.groupBy("slide_id").agg(F.sum(F.when((F.col("type") != "Point") & ~F.col("classified"), F.col("n")).otherwise(0)).alias("n"))
    chosen = calibrate.default_selection(points) if selection is None else selection
    covered = calibrate.coverage(clean.shapes(features), calibrate.triangles(chosen, points))
    lacks = [F.struct(F.lit(c).alias("column"), (F.lit(0).cast("long") if c == "classification" else F.col(f"no_{c}")).alias("n")) for c in EXPORTED]
    exported = shapes.groupBy("slide_id").agg(*[F.sum(f"no_{c}").alias(f"no_{c}") for c in EXPORTED if c != "classification"]).select("slide_id", F.inline(F.array(*lacks)))
    parts = [
        _row(counts, "empty_input", _when(F.col("n") == 0, "error"), F.col("n")),
        _row(counts, "no_names", _when(F.col("named") == 0, "error"), F.col("named")),
        _row(total(counted, "slide_id", "type"), "geometry", "info", F.col("n"), F.col("type")),
        _row(bare, "unclassified", _when(F.col("n") > 0, "warn"), F.col("n")),
        _row(total(classified.where(~cuttable), "slide_id", "type"), "rejected", "warn", F.col("n"), F.col("type")),
        _row(calibrate.missing(chosen, points), "calibration_missing", "error", F.lit(1), F.col("name")),
        _row(covered, "coverage", F.when(F.col("status") == "ok", "info").otherwise("warn"), F.col("hits"), F.coalesce("report", "status")),
        _row(exported, "export_nulls", _when(F.col("n") > 0, "error"), F.col("n"), F.col("column")),
    ]
    if class_wells is not None:
        nowhere = lambda df: df.withColumn("slide_id", F.lit(None).cast("string"))
        rows, cols = check_plate(plate)
        room = rows * cols if usable is None else usable.select("well").distinct().count()  # a plate's wells at most
        unmapped = total(shapes.join(class_wells.select("class_name").distinct(), "class_name", "left_anti"), "slide_id", "class_name")
        parts += [
            _row(nowhere(missing_classes(shapes, class_wells)), "missing_class", "warn", F.lit(1), F.col("class_name")),
            _row(nowhere(invalid_wells(class_wells, plate)), "invalid_well", "error", F.lit(1), F.concat_ws(" ", "class_name", "well")),
            _row(nowhere(shared_wells(class_wells)), "shared_well", "info", F.col("n"), F.concat_ws(": ", "well", "classes")),
            _row(nowhere(shapes.agg(F.countDistinct("class_name").alias("n"))), "capacity", _when(F.col("n") > room, "warn"), F.col("n"), f"{room} wells"),
            _row(unmapped, "no_well", "warn", F.col("n"), F.col("class_name")),
        ]
    return reduce(DataFrame.unionByName, parts)
