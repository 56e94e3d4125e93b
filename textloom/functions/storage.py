"""Reading the input tables, and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame) -> str:
    """A hash of the files that a table is read from: names, sizes and times, not rows."""
    files = df.select(*(F.col(f"_metadata.file_{c}").alias(c) for c in ("path", "size", "modification_time"))).distinct()
    return "%016x" % (int(files.agg(F.coalesce(F.sum(F.xxhash64("path", "size", "modification_time").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()["h"]) % (1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is unset on one machine (tests). On a cluster there must be one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Unlike ``checkpoint()`` the rows are computed a single time and stay columnar, so later
    readers still prune columns; like it, the result survives the loss of any executor. The path is added to ``made``, for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _MADE.append((spark, path))
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """A folder written by other means is deleted with the tables of ``materialize``."""
    _MADE.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def discard(paths: list[str]) -> None:
    """Delete tables that nothing will read any more, such as those of earlier rounds."""
    gone = set(paths)
    for spark, path in [m for m in _MADE if m[1] in gone]:
        _delete(spark, path)
    _MADE[:] = [m for m in _MADE if m[1] not in gone]


@atexit.register
def release() -> None:
    """Delete the tables that ``materialize`` wrote; plans that read them are invalid afterwards. A long session calls it between jobs."""
    while _MADE:
        _delete(*_MADE.pop())
