"""Session-level helpers: the shared folder, tables in it, resources and timers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or, where that is unset and all is one machine, a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes with the process."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            remove(spark, path)

    atexit.register(drop)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder, written now."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order of its partitions.

    Rows are numbered within their partitions and written, so that a repeated task can't number them
    anew; then each partition starts where those before it end. Only their sizes meet in one task.
    """
    held = saved(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy(part).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return held.withColumn("__part", part).join(F.broadcast(first), "__part").select(*df.columns, place)  # a row per partition


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: their Python workers needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_vectide_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vectide-")) / "vectide.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"vectide/{f.relative_to(package)}")
    sc.addPyFile(str(target))
    sc._vectide_shipped = True


def resources(spark: SparkSession) -> dict[str, int | str]:
    """What the session has to work with."""
    sc = spark.sparkContext
    return {"master": sc.master, "cores": sc.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "version": spark.version}


@contextlib.contextmanager
def timed(label: str, log: dict[str, float] | None = None) -> Iterator[None]:
    """Wall seconds of what runs within, printed as milliseconds or added to ``log``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        s = time.perf_counter() - began
        if log is None:
            print(f"{label}: {s * 1000:.3f} ms")
        else:
            log[label] = log.get(label, 0.0) + s


def run(df: DataFrame) -> None:
    """Computes all of df and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
