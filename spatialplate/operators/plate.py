"""Layouts: classes on wells, in order or shuffled by a seed, and plates as grids.

Every function takes `keys`: a layout is made for each of their values in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..schemas import PLATES
from ..sources import check_plate, plate_grid

Keys = tuple[str, ...]
#: Wells of the largest plate.
MOST = max(rows * cols for rows, cols in PLATES.values())


def classes_of(shapes: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distinct classes; shapes without one take no well."""
    return shapes.where(F.col("class_name").isNotNull()).select(*keys, "class_name").distinct()


def _numbered(df: DataFrame, keys: Keys, *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*(keys or (F.lit(0),))).orderBy(*order)))


def _mixed(seed: int, column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)))


def assign(classes: DataFrame, wells: DataFrame, keys: Keys = (), seed: int | None = None) -> DataFrame:
    """(keys, class_name, well, ord): classes by name on wells in plate order, or in the seed's order of wells; the rest of the longer side stays out.

    Plates have at most 384 wells: of more classes only the first are numbered,
    which each task picks from its own rows before they are brought together.
    """
    if not keys:
        classes = classes.orderBy("class_name").limit(MOST)
    placed = _numbered(wells, keys, *(["pos"] if seed is None else [_mixed(seed, "well"), F.col("well")])).select(*keys, "well", "_n")
    return _numbered(classes, keys, "class_name").where(F.col("_n") <= MOST).join(placed, [*keys, "_n"]).select(*keys, "class_name", "well", F.col("_n").alias("ord"))


def unplaced(classes: DataFrame, wells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Classes that an assignment has no well for."""
    return classes.select(*keys, "class_name").join(assign(classes, wells, keys).select(*keys, "class_name"), [*keys, "class_name"], "left_anti")


def capacity(classes: DataFrame, wells: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, classes, wells, fits)."""
    c = classes.groupBy(*keys).agg(F.countDistinct("class_name").alias("classes"))
    w = wells.groupBy(*keys).agg(F.count("*").alias("wells"))
    both = c.join(w, list(keys), "left") if keys else c.crossJoin(w)
    return both.select(*keys, "classes", F.coalesce("wells", F.lit(0)).alias("wells")).withColumn("fits", F.col("classes") <= F.col("wells"))


def placed_on_grid(assignments: DataFrame, grid: DataFrame, keys: Keys = ()) -> DataFrame:
    """The grid with class_name in each well, blank where there is none; of classes that share a well the last one shows."""
    last = assignments.groupBy(*keys, "well").agg(F.max_by("class_name", "ord").alias("class_name"))
    return grid.drop("cell").join(last, [*keys, "well"], "left").withColumn("class_name", F.coalesce("class_name", F.lit("")))


def pivoted(placed: DataFrame, plate: str = "384", keys: Keys = ()) -> DataFrame:
    """(keys, row, 1..C): a plate as people see it."""
    columns = [str(i + 1) for i in range(check_plate(plate)[1])]
    rows = placed.withColumn("row", N.well_row(F.col("well"))).withColumn("_col", F.col("col_idx").cast("string"))
    return rows.groupBy(*keys, "row").pivot("_col", columns).agg(F.max("class_name"))


def unpivoted(plate: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, class_name, well, ord): what a filled plate says, row by row; blanks are skipped, and a class that stands twice has its last well."""
    columns = [c for c in plate.columns if c not in (*keys, "row")]
    cells = plate.unpivot([*keys, "row"], columns, "_col", "class_name").where(F.col("class_name").isNotNull() & (F.col("class_name") != ""))
    pos = (F.ascii("row") * 100 + F.col("_col").cast("int")).alias("_pos")
    found = cells.select(*keys, "class_name", F.concat("row", "_col").alias("well"), pos)
    return found.groupBy(*keys, "class_name").agg(F.max_by("well", "_pos").alias("well"), F.max("_pos").alias("ord"))


def flagged(cells: DataFrame, wells: DataFrame, keys: Keys = ()) -> DataFrame:
    """cells with `available`: whether their well is usable."""
    usable = wells.select(*keys, "well").distinct().withColumn("available", F.lit(True))
    return cells.join(usable, [*keys, "well"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def known_cells(cells: DataFrame, classes: DataFrame, keys: Keys = ()) -> DataFrame:
    """cells(class_name) with `available`: whether the class is one of the data's."""
    known = classes.select(*keys, "class_name").distinct().withColumn("available", F.lit(True))
    return cells.join(known, [*keys, "class_name"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


__all__ = ["assign", "capacity", "classes_of", "flagged", "known_cells", "pivoted", "placed_on_grid", "plate_grid", "unpivoted", "unplaced"]
