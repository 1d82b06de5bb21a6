"""Readers: features, class-to-well maps, lists, wells and plate grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..schemas import CLASSIFICATION, COLLECTION, FEATURE, FEATURE_LINE, PLATES
from ..staging import settled


def parsed_features(raw: DataFrame, *more: Column | str) -> DataFrame:
    """raw(slide_id, ord, f) with parsed geometry and classification; and `more` of its columns."""
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parsed = F.from_json("f.properties.classification", CLASSIFICATION)
    return raw.select(
        "slide_id",
        F.col("ord").cast("long").alias("ord"),
        F.col("f.id").alias("id"),
        kind.alias("type"),
        F.col("f.properties.objectType").alias("object_type"),
        F.col("f.properties.name").alias("name"),
        parsed.alias("classification"),
        F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        G.rings(kind, coordinates).alias("rings"),
        G.point(kind, coordinates).alias("point"),
        *more,
    )


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features of FeatureCollection files, one file a slide, in file order. A file is read by one task; see read_large_features."""
    raw = spark.read.schema(COLLECTION).json(paths, multiLine=True)
    return parsed_features(raw.select(N.file_stem(F.col("_metadata.file_name")).alias("slide_id"), F.posexplode("features").alias("ord", "f")))


def read_large_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What read_features() gives, with each file read by as many tasks as it has splits; a file that is no feature collection gives no rows.

    Features are parsed where they are found and written between: who filters the result, or reads it again, parses nothing.
    """
    from .split import feature_texts, joined_parts, slide_of

    def parsed(texts: DataFrame, text: Column, *more: str) -> DataFrame:
        f = F.from_json(text, FEATURE).alias("f")
        return parsed_features(texts.select(slide_of(F.col("source")).alias("slide_id"), "ord", f, *more), F.col("f.type").alias("_is"), *more)

    part, text = F.col("part"), F.col("text")
    texts = feature_texts(spark, paths).select("source", "ord", "place", F.when(part, text).alias("_text"), F.when(~part, text).alias("text"))
    found = settled(parsed(texts, text, "source", "place", "_text"), "features")
    cut = F.col("_text").isNotNull()
    whole, parts = found.where(~cut).drop("source", "place", "_text"), found.where(cut).select("source", "ord", "place", F.col("_text").alias("text"))
    return whole.unionByName(parsed(joined_parts(parts), text)).where(F.col("_is").isNotNull()).drop("_is")


def read_feature_lines(spark: SparkSession, paths: str | list[str], ordered: bool = True) -> DataFrame:
    """Features one a line, for very large slides: splittable. Each line carries its slide_id and ord.

    Where lines lack their ord, ordered=False gives them the order of their ids,
    for which each slide is sorted as a whole.
    """
    raw = spark.read.schema(FEATURE_LINE).json(paths)
    if ordered:
        return parsed_features(raw.select("slide_id", "ord", F.struct("id", "geometry", "properties").alias("f")))
    own = F.row_number().over(W.partitionBy("slide_id").orderBy("id")).cast("long") - 1
    return parsed_features(raw.select("slide_id", F.coalesce("ord", own).alias("ord"), F.struct("id", "geometry", "properties").alias("f")))


def parsed_map(text: Column) -> Column:
    """A dict's text, JSON or Python, with a byte order mark or a trailing comma; an empty map if it cannot be read."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r",\s*\}", "}")
    return F.coalesce(F.from_json(plain, "map<string,string>"), F.create_map().cast("map<string,string>"))


def read_class_wells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(class_name, well, ord) of map files."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.posexplode(parsed_map(F.col("value"))).alias("ord", "class_name", "well")).select("class_name", "well", "ord")


def exploded_list(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, pos, item): a list's items between commas, trimmed, empty ones dropped."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*keys, F.posexplode(items).alias("pos", "item"))


def check_plate(plate: str) -> tuple[int, int]:
    if plate not in PLATES:
        raise ValueError("plate must be '384' or '96'")
    return PLATES[plate]


def _span(start: Column, stop: Column, step: Column) -> Column:
    """start, start + step, ... up to stop; empty where stop is before start."""
    return F.when(stop >= start, F.sequence(start, F.greatest(start, stop), step)).otherwise(F.array().cast("array<int>"))


def wells(layouts: DataFrame, plate: str = "384", margin: Column | int = 0, step_row: Column | int = 1, step_col: Column | int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, well, row_idx, col_idx, pos): usable wells of each row of `layouts`, row by row.

    A margin of 0 or less takes nothing off; one too large leaves no well.
    Margins and steps may be columns of `layouts`.
    """
    rows, cols = check_plate(plate)
    for value in (margin, step_row, step_col):
        if not isinstance(value, (int, Column)) or isinstance(value, bool):
            raise ValueError("margin and steps must be whole numbers")
    if any(isinstance(s, int) and s < 1 for s in (step_row, step_col)):
        raise ValueError("steps must be positive")
    off, down, along = (v if isinstance(v, Column) else F.lit(v) for v in (margin, step_row, step_col))
    off = F.greatest(off, F.lit(0)).cast("int")
    row_list, col_list = _span(off + 1, F.lit(rows) - off, down.cast("int")), _span(off + 1, F.lit(cols) - off, along.cast("int"))
    all_rows = layouts.select(*keys, F.explode(row_list).alias("row_idx"), col_list.alias("_cols"), F.size(col_list).alias("_n"), off.alias("_off"), down.cast("int").alias("_down"))
    out = all_rows.select("*", F.posexplode("_cols").alias("_k", "col_idx"))
    pos = F.floor((F.col("row_idx") - F.col("_off") - 1) / F.col("_down")) * F.col("_n") + F.col("_k") + 1
    return out.select(*keys, N.well_name(F.col("row_idx"), F.col("col_idx")).alias("well"), "row_idx", "col_idx", pos.cast("int").alias("pos"))


def plate_grid(layouts: DataFrame, plate: str = "384", blank: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """All wells of the plate, with `cell`: the well's own name, or blank."""
    out = wells(layouts, plate, keys=keys)
    return out.withColumn("cell", F.lit("") if blank else F.col("well"))
