"""Tables, derived survey views on them, and the registration of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Survey views in integer arithmetic: source table and select list, the same text for Spark and DuckDB.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "vines": ("lineitem", ["cast(l_suppkey % 20 as int) as block_no", "cast(l_partkey % 25 as int) as row_no", "l_orderkey", "l_linenumber", "cast(round(l_extendedprice*100) as bigint) % 12000 as s_cm", "cast(l_linenumber*250 as bigint) as t_cm"]),
    "segments": ("orders", ["o_orderkey as seg_id", "cast(o_custkey % 35 as int) as r", "cast(o_orderkey % 34 as int) as c", "cast((o_orderkey*7) % 180 as int) as angle_deg", "cast(round(o_totalprice*100) as bigint) % 5120 as len_cm", "concat('V', lpad(cast(o_custkey % 12 as varchar(4)),2,'0')) as block_id"]),
    "boxes": ("part", ["p_partkey as box_id", "cast((p_partkey*37) % 2048 as int) as xtl", "cast((p_partkey*91) % 2048 as int) as ytl", "cast((p_partkey*37) % 2048 as int)+10+p_size as xbr", "cast((p_partkey*91) % 2048 as int)+10+cast((p_size*7) % 30 as int) as ybr", "p_retailprice as score", "cast(p_partkey % 9 as int) as tile_no"]),
    "walk": ("events", ["user_id", "event_id", "ts", "event_type", "value"]),
    "cells": ("lineitem", ["cast(l_partkey % 64 as int) as col", "cast(l_suppkey % 64 as int) as row_", "cast(l_quantity as int) as v", "cast(l_orderkey % 256 as int) as red", "cast(l_partkey % 256 as int) as green", "cast(l_suppkey % 256 as int) as blue"]),
    "strips": ("orders", ["o_orderkey as strip_id", "cast(o_custkey as int) as block_no", "cast(round(o_totalprice*100) as bigint) % 3000 as t_cm", "cast(o_orderkey % 4000 as bigint) as s0_cm", "cast(o_orderkey % 4000 as bigint) + 500 + cast(round(o_totalprice) as bigint) % 4000 as s1_cm"]),
    "points": ("supplier", ["s_suppkey as pid", "cast((s_suppkey*193) % 3001 as bigint) as x_cm", "cast((s_suppkey*389) % 2999 as bigint) as y_cm", "cast(s_nationkey as int) as kind"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def with_views(sql: str) -> str:
    """The SQL with the views that it names defined in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in used)
    body = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s", body)
    rest = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body) if re.match(r"(?i)with\s", body) else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}" + (f", {rest}" if rest is not None else f" {body}")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame by its name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add
