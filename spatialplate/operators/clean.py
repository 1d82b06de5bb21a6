"""From features to cuttable shapes and calibration points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTTABLE = ("Polygon", "LineString")


def census(features: DataFrame) -> DataFrame:
    """(slide_id, type, n): features by geometry type."""
    return features.groupBy("slide_id", "type").agg(F.count("*").alias("n"))


def census_text(features: DataFrame) -> DataFrame:
    """(slide_id, report): such as `3 Points, 6 Polygons`."""
    return census(features).groupBy("slide_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("n").cast("string"), F.lit(" "), "type", F.lit("s")))), ", ").alias("report"))


def points(features: DataFrame) -> DataFrame:
    return features.where(F.col("type") == "Point")


def not_points(features: DataFrame) -> DataFrame:
    return features.where(F.col("type") != "Point")


def calibration_points(features: DataFrame) -> DataFrame:
    """(slide_id, name, x, y, first_ord): named points; of a repeated name the last place counts, at the position of the first."""
    named = points(features).where(F.col("name").isNotNull() & (F.col("name") != ""))
    best = named.groupBy("slide_id", "name").agg(F.max_by("point", "ord").alias("p"), F.min("ord").alias("first_ord"))
    return best.select("slide_id", "name", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "first_ord")


def classified(features: DataFrame) -> DataFrame:
    """Features other than points that have a classification, with class_name (null if it has no name)."""
    return not_points(features).where(F.col("classification").isNotNull()).withColumn("class_name", F.col("classification.name"))


def shapes(features: DataFrame) -> DataFrame:
    """Classified polygons and line strings."""
    return classified(features).where(F.col("type").isin(*CUTTABLE))


def rejected(features: DataFrame) -> DataFrame:
    """Classified features that cannot be cut, with a reason."""
    other = classified(features).where(~F.coalesce(F.col("type").isin(*CUTTABLE), F.lit(False)))
    reason = F.when(F.col("type") == "MultiPolygon", "several polygons in one feature: split them").otherwise(F.concat(F.lit("unsupported geometry: "), F.coalesce("type", F.lit("none"))))
    return other.select("slide_id", "ord", "id", "type", "class_name", reason.alias("reason"))


def unclassified(features: DataFrame) -> DataFrame:
    """(slide_id, n): features other than points without a classification."""
    return features.groupBy("slide_id").agg(F.count_if((F.col("type") != "Point") & F.col("classification").isNull()).alias("n"))


def nulls(df: DataFrame, keys: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """(keys, column, n): nulls of each other column, counted in one pass."""
    rest = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rest])
    return counts.unpivot(list(keys), rest, "column", "n")
