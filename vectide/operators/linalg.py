"""Matrix algebra on coordinate (i, j, v) and row (id, vector) frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import squared_norm
from vectide.operators.knn import QUERY_BYTES, TILE_BYTES, matrix
from vectide.runtime import saved


def coordinates(rows: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """(i, j, v) of rows(id, vector); j counts from 0."""
    return rows.select(F.col(id).cast("bigint").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def rows_of(cells: DataFrame) -> DataFrame:
    """(id, vector) of (i, j, v), elements in order of j."""
    g = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    return g.select(F.col("i").alias("id"), F.col("c.v").alias("vector"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, trans_a: bool = False, trans_b: bool = False, trans_c: bool = False, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """alpha * op(A) op(B) + beta * C over coordinate frames, transposed at the end if trans_c.

    An equi-join on the inner index and a sum that is combined before its shuffle; absent cells are 0.
    """
    a, b = (transpose(a) if trans_a else a), (transpose(b) if trans_b else b)
    left, right = a.select("i", F.col("j").alias("inner"), F.col("v").alias("x")), b.select(F.col("i").alias("inner"), "j", F.col("v").alias("y"))
    out = left.join(right, "inner").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y") * F.lit(float(alpha))).alias("v"))
    if c is not None and beta:
        c = transpose(c) if trans_c else c
        out = out.unionByName(c.select("i", "j", (F.col("v") * F.lit(float(beta))).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return transpose(out) if trans_c else out


def row_products(a: DataFrame, b: DataFrame, alpha: float = 1.0, b_bytes: int = QUERY_BYTES) -> DataFrame:
    """(i, j, v): alpha times the dot products of rows of a(id, vector) and b(id, vector).

    b travels to a as a matrix of checked size, beyond ``b_bytes`` in blocks, each written before the next is read; products are BLAS calls on tiles of bounded size.
    """
    import pyarrow.compute  # noqa: F401

    size = int(b.agg(F.sum(F.size("vector").cast("bigint") * 8)).first()[0] or 0)
    parts, out = max(1, -(-size // b_bytes)), None
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])
    for n in range(parts):
        block = b if parts == 1 else b.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)
        found = block.select(F.col("id").cast("bigint").alias("id"), "vector").toArrow()
        ids = found["id"].to_numpy()
        shared = a.sparkSession.sparkContext.broadcast((ids, matrix(found["vector"].combine_chunks()) if len(ids) else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute  # noqa: F401

            ids, right = shared.value
            rows = max(1, min(256, TILE_BYTES // (24 * max(1, len(ids)))))
            for rb in batches:
                for at in range(0, rb.num_rows if len(ids) else 0, rows):
                    part = rb.slice(at, rows)
                    v = alpha * (matrix(part.column(1)) @ right.T)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(ids))), pa.array(np.tile(ids, len(v))), pa.array(v.ravel())], schema=schema)

        part = a.select(F.col("id").cast("bigint").alias("id"), "vector").mapInArrow(run, "i bigint, j bigint, v double")
        if parts > 1:
            part = saved(part, "products")
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def add_per_row(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells(i, j, v) with the value of values(i, value) added along each row."""
    return cells.join(values, "i").select("i", "j", (F.col("v") + F.col("value")).alias("v"))


def add_to_rows(rows: DataFrame, value: str) -> DataFrame:
    """rows(id, vector, value) with that value added to all elements: no join where it travels with the row."""
    return rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double") + F.col(value)))


def norms(rows: DataFrame, squared: bool = True) -> DataFrame:
    """(id, norm) of rows(id, vector)."""
    n = squared_norm("vector")
    return rows.select("id", (n if squared else F.sqrt(n)).alias("norm"))


def norms_of_cells(cells: DataFrame, squared: bool = True) -> DataFrame:
    """(i, norm) of coordinate cells."""
    n = F.sum(F.col("v") * F.col("v"))
    return cells.groupBy("i").agg((n if squared else F.sqrt(n)).alias("norm"))


def gaussian(spark, rows: int, dim: int, mean: float = 0.0, stddev: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, vector): independent normal elements. The same seed gives the same matrix for the same number of partitions."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.randn(seed) * stddev + mean).cast("float"))
    return spark.range(rows).select("id", cells.alias("vector"))


def constant(spark, rows: int, dim: int, value: float = 0.0) -> DataFrame:
    """(id, vector) with one value everywhere; zeros by default."""
    return spark.range(rows).select("id", F.array_repeat(F.lit(value).cast("float"), dim).alias("vector"))
