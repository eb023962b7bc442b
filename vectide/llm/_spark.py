"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.runtime import remove, shared_folder, ship

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and Arrow batches bounded by bytes."""
    ship(spark)
    bounded_batches(spark)
    return spark


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on the session hands Arrow batches of at most about ``size`` bytes to Python: by the default of 64 MB, long texts add up in the buffers of both sides."""
    spark.conf.set(BATCH_BYTES, str(size))


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """bounded_batches() for the jobs within it."""
    before = spark.conf.get(BATCH_BYTES)
    bounded_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


class Scratch:
    """Intermediate tables in the shared folder. They survive the loss of executors and end with the session, or with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        with contextlib.suppress(Exception):
            for path in [t._scratch_path for t in tables] or [self.root]:
                remove(self.spark, path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more; it learns of them from its garbage collector."""
    gc.collect()
    spark._jvm.System.gc()


def given_back() -> None:
    """Gives what a task has freed back to the system: workers outlive tasks and stages, and an idle one would keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with given_back() at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            given_back()

    return run


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def crc_mod(column: str, m: int) -> F.Column:
    """crc32(column as text) mod m; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id of the undirected edges (a, b); component is the smallest id reachable.

    Each round every component takes the smallest component it touches, chains
    are shortened by pointer jumping, and edges inside a component go, so the
    edge list shrinks round by round. Minima are combined before the shuffle, so
    a star with millions of rays costs one row per task. Nothing is collected.
    """
    pairs = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component")))
    while not pairs.isEmpty():
        # every root hangs below the smallest neighbour that is smaller than itself
        up = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        parent = scratch.save(up)
        while True:
            p2 = parent.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            jumped = scratch.save(parent.join(p2, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            scratch.drop(parent)
            parent = jumped.select("id", "parent")
            parent._scratch_path = jumped._scratch_path
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("id").alias("component"), F.col("parent").alias("root"))
        new = scratch.save(label.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        ta, tb = parent.select(F.col("id").alias("a"), F.col("parent").alias("ra")), parent.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        moved = pairs.join(ta, "a", "left").join(tb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        left = scratch.save(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(pairs, label, parent)
        pairs, label = left, new
    return label
