"""Shared helpers of the llm operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from terrarow.storage import drop_path, new_path, shared_dir, stored

__all__ = ["SLICE", "SLICE_BYTES", "drop_path", "map_rows", "new_path", "shared_dir", "stored", "table"]

#: Rows, and bytes of input about, that one Python call handles at a time; both bound a worker's memory.
SLICE, SLICE_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with fn called on slices of at most SLICE rows and of SLICE_BYTES about; fn yields dicts of columns."""
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                for columns in fn(batch.slice(at, step)):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
