"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list["Tables"] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, an own folder of a local session, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='terrarow-')}"
        base = _own[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a session that has ended is left alone."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


#: Spark keeps the files of a shuffle until the driver's garbage is collected; where this is set, until the statement ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting within; it comes back behind."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives lost executors, and leaves no shuffle behind."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _set(spark, _CLEAN, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for tables in _open:
        tables.paths.append(path)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that stored gave, and none made from them, so that disk holds only what is still read."""
    for df in frames:
        if path := vars(df).pop("_stored_at", None):
            drop_path(df.sparkSession, path)


class Tables:
    """The tables that were stored since."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, *frames: DataFrame) -> None:
        """Delete all of them but those that frames read."""
        used = {f.split("/")[-2] for df in frames for f in df.inputFiles()}
        for path in self.paths:
            if path.rpartition("/")[2] not in used:
                drop_path(self.spark, path)
        self.paths = [path for path in self.paths if path.rpartition("/")[2] in used]


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """Collects the tables that are stored within, for keep."""
    own = Tables(spark)
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)


@contextmanager
def without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """No table is sent through the driver by tables stored within, whatever the size of its files; the setting comes back behind.

    Stored tables are small files of many rows: Spark judges by the files, or by compressed shuffle blocks, and a table of 10 MB there
    is some 200 MB in the driver.
    """
    with _set(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        yield
