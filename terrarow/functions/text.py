"""Text formats and coercions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geom import point


def parse_points(text: Column) -> Column:
    """x,y;x,y;... to points; blank parts are skipped."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: point(F.trim(F.get(F.split(p, ","), F.lit(0))), F.trim(F.get(F.split(p, ","), F.lit(1)))))


def format_points(points: Column, decimals: int = 1) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string(f"%.{decimals}f,%.{decimals}f", p["x"], p["y"])), ";")


def block_name(n: Column) -> Column:
    return F.concat(F.lit("V"), F.lpad(n.cast("string"), 2, "0"))


def row_name(block: Column, n: Column, in_block: Column) -> Column:
    """V01-R01; three digits in blocks of 100 rows or more."""
    return F.concat(block, F.lit("-R"), F.when(in_block >= 100, F.lpad(n.cast("string"), 3, "0")).otherwise(F.lpad(n.cast("string"), 2, "0")))


def normal_email(text: Column) -> Column:
    """Trimmed and lower-cased if it looks like an address, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), t)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    return text.try_cast("double")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def metres(v: Column) -> Column:
    return F.concat(F.format_string("%.1f", v), F.lit(" m"))


def square_metres(v: Column) -> Column:
    return F.concat(F.format_string("%.2f", v), F.lit(" m²"))


def hectares(v: Column) -> Column:
    return F.concat(F.format_string("%.4f", v), F.lit(" ha"))


def natural_key(name: Column) -> tuple[Column, Column]:
    """Sort keys that take the first number in a name as a number."""
    return F.regexp_extract(name, r"^\D*", 0), F.coalesce(F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).cast("bigint"), F.lit(-1))


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return 2 * green - red - blue


def cover_class(share: Column) -> Column:
    """bare_soil below a quarter of green, vegetation above three quarters, else mixed; null: unassessable."""
    return F.when(share.isNull(), "unassessable").when(share < 0.25, "bare_soil").when(share > 0.75, "vegetation").otherwise("mixed")
