"""Writers: cutting jobs, plates, maps, features and palettes. Output goes to one folder a slide, by Spark's writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.clean import nulls
from ..operators.plate import pivoted
from ..schemas import EXPORTED
from ..staging import settled


def write_ordered(rows: DataFrame, path: str, *order: str, keep: bool = False) -> None:
    """rows(slide_id, order, value) as text: a folder slide_id=... for each, whose parts hold its lines in order of their names.

    Rows are dealt to tasks by ranges of slide and place, so that a slide of any
    size is written by many tasks, and a small one lies in one part (or in two,
    where a range ends in it). The ranges take a look at the rows of their own,
    so these are worked out and written before. Parts are written to a folder
    aside first; only when all are there, slide after slide moves into place.
    With `keep` other slides that stand there stay.
    """
    spark = rows.sparkSession
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    places = ["slide_id", *order]
    settled(rows.select(*places, "value"), "rows").repartitionByRange(*places).sortWithinPartitions(*places).select("slide_id", "value").write.partitionBy("slide_id").text(aside)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    files = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    of = lambda folder: {x.getPath().getName(): x.getPath() for x in files.listStatus(to_path(folder)) if x.getPath().getName().startswith("slide_id=")}
    new, old = of(aside), of(path)
    for name, where in old.items():
        if name in new or not keep:
            files.delete(where, True)
        if name in new:
            files.rename(new[name], where)
    for name in new.keys() - old.keys():
        files.rename(new[name], to_path(f"{path.rstrip('/')}/{name}"))
    files.delete(to_path(aside), True)


def write_xml(lines: DataFrame, path: str, keep: bool = False) -> None:
    """lines of xml_lines(): a cutting job in each slide_id= folder; its parts one after the other are the document."""
    write_ordered(lines.withColumnRenamed("s", "value"), path, "shape_no", "line_no", keep=keep)


def write_plate(placed: DataFrame, path: str, plate: str = "384", keys: tuple[str, ...] = ()) -> None:
    """A placed grid as CSV: a blank header cell, columns 1..C, and the rows' letters. The folder's name tells the plate."""
    wide = pivoted(placed, plate, keys).withColumnRenamed("row", "")
    options = {"header": True, "emptyValue": ""}
    if keys:
        wide.repartition(*keys).sortWithinPartitions(*keys, "").write.mode("overwrite").partitionBy(*keys).options(**options).csv(path)
    else:
        wide.coalesce(1).sortWithinPartitions("").write.mode("overwrite").options(**options).csv(path)


def map_text(class_wells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): the map as JSON, in the map's order; at most one entry a class."""
    entries = F.sort_array(F.collect_list(F.struct("ord", "class_name", "well")))
    return class_wells.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e.class_name, e.well)))).alias("value"))


def write_map(class_wells: DataFrame, path: str) -> None:
    map_text(class_wells).coalesce(1).write.mode("overwrite").text(path)


def sanitised(shapes: DataFrame) -> DataFrame:
    """(slide_id, ord, id, objectType, classification, geometry): what an export needs; see export_errors()."""
    return shapes.select("slide_id", "ord", "id", F.col("object_type").alias("objectType"), "classification", "geometry")


def export_errors(shapes: DataFrame) -> DataFrame:
    """(slide_id, column, n): needed columns that hold nulls in a slide; such a slide's export would lack the column."""
    return nulls(sanitised(shapes).drop("ord")).where(F.col("column").isin(*EXPORTED) & (F.col("n") > 0))


def feature_text(shapes: DataFrame) -> DataFrame:
    """(slide_id, ord, value): each feature as one line of GeoJSON; coordinates go as the numbers that were read."""
    rest = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id")))
    properties = F.to_json(F.struct(F.col("objectType").alias("objectType"), F.col("classification")))
    shape = F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.regexp_replace("geometry.coordinates", r"\s+", ""), F.lit("}"))
    value = F.concat(F.expr("left(_rest, length(_rest) - 1)"), F.lit(',"geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}"))
    return sanitised(shapes).withColumn("_rest", rest).select("slide_id", "ord", value.alias("value"))


def collection_lines(shapes: DataFrame) -> DataFrame:
    """(slide_id, ord, value): the lines of one FeatureCollection a slide, a feature each, after a line that opens it and before one that closes it. First and last places, a row a slide, are broadcast."""
    rows = feature_text(shapes)
    ends = rows.groupBy("slide_id").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    listed = rows.join(F.broadcast(ends), "slide_id").select("slide_id", "ord", F.concat(F.when(F.col("ord") == F.col("_first"), "").otherwise(","), "value").alias("value"))
    line = lambda ord_, value: F.struct(ord_.alias("ord"), F.lit(value).alias("value"))
    frame = ends.select("slide_id", F.inline(F.array(line(F.col("_first") - 1, '{"type":"FeatureCollection","features":['), line(F.col("_last") + 1, "]}"))))
    return listed.unionByName(frame)


def write_features(shapes: DataFrame, path: str, collection: bool = False, keep: bool = False) -> None:
    """Clean features as GeoJSON: a feature a line, or one FeatureCollection a slide, whose parts one after the other are the document."""
    write_ordered(collection_lines(shapes) if collection else feature_text(shapes), path, "ord", keep=keep)


def palette_text(classes: DataFrame) -> DataFrame:
    """(value): classes(pos, class_name, color) as the palette's JSON. Class lists are typed in, so one value holds them."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "class_name", "color"))), lambda e: F.struct(e.class_name.alias("name"), e.color.alias("color")))
    return classes.agg(F.to_json(F.struct(listed.alias("pathClasses"))).alias("value"))


def write_palette(classes: DataFrame, path: str) -> None:
    palette_text(classes).coalesce(1).write.mode("overwrite").text(path)


def with_palette(classes: DataFrame) -> DataFrame:
    """classes(class_name) numbered by name, with the palette's colours in rotation."""
    pos = F.row_number().over(W.orderBy("class_name")) - 1
    return classes.select("class_name").distinct().withColumn("pos", pos).withColumn("color", N.palette_colour(F.col("pos")))


def store_features(features: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """features as the table `table`, bucketed by slide and sorted by place in each; and that table.

    A slide lies in one bucket, so that what is worked out by slide needs no
    exchange (see with_wells(stored=True)). That suits many slides of up to some
    million features; one that holds a large share of all is better left to the
    ranges of numbering.numbered().
    """
    writer = features.repartition(buckets, "slide_id").write.mode("overwrite").bucketBy(buckets, "slide_id").sortBy("slide_id", "ord")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return features.sparkSession.table(table)
