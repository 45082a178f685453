"""Annotation XML (CVAT for images 1.1) by Spark's XML source, and its text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrarow.functions.geom import box_ring
from terrarow.functions.text import basename, format_points, parse_points

_ATTRIBUTE = "array<struct<_name:string,_VALUE:string>>"
_SHAPE = f"array<struct<_label:string,_points:string,attribute:{_ATTRIBUTE}>>"
SCHEMA = f"_id int, _name string, _width int, _height int, polygon {_SHAPE}, polyline {_SHAPE}, box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{_ATTRIBUTE}>>"

#: Values of attributes that an older file may lack.
DEFAULTS = {"vineyard_id": "V01", "row_id": "V01-R01", "row_structure": "regular", "interrow_cover": "bare_soil"}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One line per image with its shapes; broken records are skipped."""
    return spark.read.format("xml").option("rowTag", "image").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)


def shapes(images: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """image, label, shape, ring, attributes: one line per shape; boxes become rings; of equal image names the last stays.

    defaults fill missing attributes (a dict of its own for files whose attributes are all optional: {}).
    """
    last = Window.partitionBy("name").orderBy(F.desc("_id"))
    own = images.withColumn("name", basename(F.col("_name"))).withColumn("_n", F.row_number().over(last)).where("_n = 1")

    def attributes(s):
        pairs = F.transform(F.coalesce(s["attribute"], F.array().cast(_ATTRIBUTE)), lambda a: F.struct(a["_name"].alias("key"), F.coalesce(a["_VALUE"], F.lit("")).alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))

    def of(kind, ring):
        return F.transform(F.coalesce(F.col(kind), F.array().cast(dict(images.dtypes)[kind])), lambda s: F.struct(F.lit(kind).alias("shape"), s["_label"].alias("label"), ring(s).alias("ring"), attributes(s).alias("attributes")))

    points = lambda s: parse_points(s["_points"])
    every = F.concat(of("polygon", points), of("polyline", points), of("box", lambda s: box_ring(s["_xtl"], s["_ytl"], s["_xbr"], s["_ybr"])))
    out = own.select(F.col("name").alias("image"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode(every).alias("s")).select("image", "width", "height", "s.*")
    if defaults:
        known = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
        out = out.withColumn("attributes", F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(F.col("attributes"), k)), F.col("attributes")))
    return out


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def shape_xml(shape: Column, label: Column, ring: Column, attributes: Column, decimals: int = 1) -> Column:
    """One polygon, polyline or box element."""
    inner = F.array_join(F.transform(F.map_entries(attributes), lambda a: F.concat(F.lit('<attribute name="'), _escaped(a["key"]), F.lit('">'), _escaped(a["value"]), F.lit("</attribute>"))), "")
    number = lambda p, c: F.format_string(f"%.{decimals}f", p[c])
    box = F.concat(F.lit('<box label="'), _escaped(label), F.lit('" xtl="'), number(F.get(ring, F.lit(0)), "x"), F.lit('" ytl="'), number(F.get(ring, F.lit(0)), "y"), F.lit('" xbr="'), number(F.get(ring, F.lit(2)), "x"), F.lit('" ybr="'), number(F.get(ring, F.lit(2)), "y"), F.lit('">'), inner, F.lit("</box>"))
    line = F.concat(F.lit("<"), shape, F.lit(' label="'), _escaped(label), F.lit('" points="'), format_points(ring, decimals), F.lit('">'), inner, F.lit("</"), shape, F.lit(">"))
    return F.when(shape == "box", box).otherwise(line)


def image_xml(rows: DataFrame, decimals: int = 1) -> DataFrame:
    """image, xml: one image element per image that has shapes; ids count from 0 in the order of names."""
    elements = rows.groupBy("image", "width", "height").agg(F.array_sort(F.collect_list(shape_xml(F.col("shape"), F.col("label"), F.col("ring"), F.col("attributes"), decimals))).alias("e"))
    head = F.format_string('<image id="%d" name="%s" width="%d" height="%d">', F.row_number().over(Window.orderBy("image")) - 1, _escaped(F.col("image")), F.col("width"), F.col("height"))
    return elements.select("image", F.concat(head, F.array_join("e", ""), F.lit("</image>")).alias("xml"))


def write_images(rows: DataFrame, path: str, part: str | None = None, decimals: int = 1) -> None:
    """Image elements as text files, in a folder for each value of part where one is named."""
    out = image_xml(rows, decimals)
    if part:
        out.join(rows.select("image", part).distinct(), "image").select(part, "xml").write.partitionBy(part).text(path)
    else:
        out.select("xml").write.text(path)
