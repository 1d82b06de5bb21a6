"""A collection from start to end: files of slides in, cutting jobs, plates, features and a report out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..operators import calibrate, clean, collection, plate, validate
from ..sources.split import source
from ..staging import settled

#: Bytes of a file whose content is hashed.
HASHED = 1 << 30


def collect_slides(spark: SparkSession, features: DataFrame, class_wells: DataFrame, out: str, plate_type: str = "384", selection: DataFrame | None = None, tolerance: float | None = 1.0, usable: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Write every slide's cutting job, clean features, the plate and the map under `out`; return the quality report.

    A slide whose features lack what an export needs (see export_errors()) gets
    no feature file; the report says so. usable(well) are the wells that may be
    used, if not all. With `keep`, other slides' files that stand under `out`
    stay. features is best a table that was written once, as read_large_features()
    gives it: it is read several times.
    """
    shapes, points = clean.shapes(features), clean.calibration_points(features)
    chosen = calibrate.default_selection(points) if selection is None else selection
    triangles = calibrate.triangles(chosen, points)
    outlined = collection.outlines(collection.with_wells(shapes, class_wells), tolerance)
    sinks.write_xml(collection.xml_lines(outlined, triangles), f"{out}/xml", keep)
    grid = sources.plate_grid(spark.range(1), plate_type)
    sinks.write_plate(plate.placed_on_grid(class_wells, grid), f"{out}/plate_{plate_type}", plate_type)
    sinks.write_map(class_wells, f"{out}/map")
    sinks.write_features(shapes.join(F.broadcast(sinks.export_errors(shapes).select("slide_id").distinct()), "slide_id", "left_anti"), f"{out}/features", keep=keep)
    return validate.quality_report(features, features.select("slide_id").distinct(), class_wells, chosen, plate_type, usable)


# Many slides, again and again.

MANIFEST = "path string, modified timestamp, length long, digest string, map string"


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest") if there else spark.createDataFrame([], MANIFEST)


def _committed(manifest: DataFrame, out: str) -> None:
    """The manifest is written aside and renamed into force; if that breaks off there is none, and the next run works on all files again."""
    spark = manifest.sparkSession
    aside, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{x}") for x in (f"_manifest-{uuid.uuid4().hex}", "_manifest"))
    manifest.write.parquet(aside.toString())
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, True)
    files.rename(aside, place)


def collect_changed(spark: SparkSession, paths: str | list[str], class_wells: DataFrame, out: str, **options: object) -> DataFrame | None:
    """collect_slides() over the collection files at `paths` that are new or changed since the last run; its report, or None if there is none of them.

    A manifest under `out` holds each file's time, length and hash, and that of
    the map. A file of the same time and length is not read; one of the same hash
    is not worked on (a file beyond HASHED bytes counts as changed). Another map
    makes all files new. The parts in a folder slide_id=... are one slide: if one
    is new, changed or gone, all that are there are read. Files of slides that are
    gone leave the manifest; what was written for them stays. The names of files
    go through the driver, their content does not.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("modificationTime").alias("modified"), "length")
    known = settled(_manifest(spark, out), "manifest")
    entry = F.to_json(F.struct("class_name", "well"))
    now = class_wells.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256)).first()[0]
    same = known.where(F.col("map") == now)
    fresh = settled(listed.join(same.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti"), "fresh")
    names = [r["path"] for r in fresh.where(F.col("length") <= HASHED).select("path").collect()]
    schema = "path string, digest string"
    hashes = spark.read.format("binaryFile").load(names).select("path", F.sha2("content", 256).alias("digest")) if names else spark.createDataFrame([], schema)
    hashed = settled(fresh.join(hashes, "path", "left"), "hashed")
    changed = hashed.join(same.select("path", "digest"), ["path", "digest"], "left_anti").select("path").unionByName(known.join(listed, "path", "left_anti").select("path"))
    changed = changed.select(source(F.col("path")).alias("source")).distinct()
    work = [r["path"] for r in listed.withColumn("source", source(F.col("path"))).join(changed, "source", "left_semi").select("path").collect()]
    report = None
    if work:
        report = settled(collect_slides(spark, sources.read_large_features(spark, work), class_wells, out, keep=True, **options), "report")
    if not fresh.isEmpty() or known.count() != listed.count():
        stay = listed.join(same, ["path", "modified", "length"]).select("path", "modified", "length", "digest", "map")
        _committed(stay.unionByName(hashed.withColumn("map", F.lit(now))), out)
    return report
