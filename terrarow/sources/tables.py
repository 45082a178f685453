"""Other inputs and outputs: tile mappings, folders of tiles, GeoJSON, box labels, datasets, measurement CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrarow.functions.geom import closed
from terrarow.functions.text import basename

_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def mapping(lines: DataFrame) -> DataFrame:
    """block, tile of lines block/tile (column value); blanks, # comments and other lines are skipped, repeats dropped."""
    parts = F.split(F.trim("value"), "/")
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#") & (F.size(parts) == 2))
    return kept.select(F.trim(F.get(parts, F.lit(0))).alias("block"), F.trim(F.get(parts, F.lit(1))).alias("tile")).distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return mapping(spark.read.text(path))


def tile_files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """tile, part, size of files below a folder; part is the nearest folder with part in its name, else default."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    return files.select(basename(F.col("path")).alias("tile"), part_of(F.col("path")).alias("part"), "size", "path")


def part_of(path: Column) -> Column:
    folders = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: F.lower(p).contains("part"))
    return F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("default"))


def first_by_precedence(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """One line per name, the first in the order given (extracted files before archive members, say)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where("_n = 1").drop("_n")


def archive_members(members: DataFrame, budget: int) -> DataFrame:
    """Members (upload, archive, place, name, size) that are tiles or annotation files, with what they and those before them use, and accepted.

    All archives of an upload share the budget, in the order of archive and place; an upload beyond it is not accepted as
    a whole, so its members all say so and none vanishes.
    """
    name = F.col("name")
    fine = ~name.endswith("/") & ~name.contains("..") & ~name.startswith("__MACOSX") & ~basename(name).startswith(".") & name.rlike(r"(?i)\.(tiff?|xml)$")
    by = Window.partitionBy("upload")
    before = F.sum("size").over(by.orderBy("archive", "place").rowsBetween(Window.unboundedPreceding, 0))
    return members.where(fine).withColumns({"used": before, "accepted": F.sum("size").over(by) <= budget})


def file_kind(content: Column) -> Column:
    """tiff or zip by the first four bytes, else null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff").when(head == "504B0304", "zip")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """place, properties, type, coordinates (JSON text) of the features of a collection."""
    return spark.read.option("multiLine", "true").schema(_FEATURES).json(path).select(F.posexplode("features").alias("place", "f")).select("place", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def feature(properties: Column, kind: Column, ring: Column) -> Column:
    """A GeoJSON feature text of a Polygon (closed on the way), LineString or Point."""
    xy = lambda p: F.array(p["x"], p["y"])
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed(ring), xy)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(ring, xy).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), xy(F.get(ring, F.lit(0))).alias("coordinates")))
    geometry = F.when(kind == "Polygon", polygon).when(kind == "LineString", line).otherwise(point)
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))


def box_labels(lines: DataFrame, classes: dict[int, int]) -> DataFrame:
    """file, cls, cx, cy, w, h of label lines (file, value), with classes renamed and others dropped."""
    p = F.split(F.trim("value"), r"\s+")
    old = F.get(p, F.lit(0)).try_cast("int")
    new = F.lit(None).cast("int")
    for a, b in classes.items():
        new = F.when(old == a, b).otherwise(new)
    got = lines.where(F.size(p) == 5).select("file", new.alias("cls"), *(F.get(p, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)))
    return got.where("cls IS NOT NULL")


def split_defects(split: DataFrame, images: DataFrame, name: str = "name") -> DataFrame:
    """defect, name: split entries without image, images without split, and names that a split holds twice."""
    missing = split.select(name).distinct().join(images.select(name), name, "left_anti").select(F.lit("missing").alias("defect"), name)
    extra = images.select(name).distinct().join(split.select(name), name, "left_anti").select(F.lit("extra").alias("defect"), name)
    twice = split.groupBy(name).count().where("count > 1").select(F.lit("twice").alias("defect"), name)
    return missing.union(extra).union(twice)


def write_measurements(rows: DataFrame, path: str) -> None:
    """Measurement lines as CSV with a header."""
    rows.write.option("header", "true").option("emptyValue", "").csv(path)
