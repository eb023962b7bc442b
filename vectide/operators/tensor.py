"""Views and shapes of matrices held as rows (id, vector)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.linalg import coordinates, rows_of


def narrow_rows(rows: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start .. start + size - 1, numbered from 0: a range predicate that reaches the scan."""
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    return rows.where((F.col("id") >= start) & (F.col("id") < start + size)).withColumn("id", F.col("id") - start)


def narrow_columns(rows: DataFrame, start: int, size: int) -> DataFrame:
    """Elements start .. start + size - 1 of every row."""
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    return rows.withColumn("vector", F.slice("vector", start + 1, size))


def reshape(rows: DataFrame, dim: int, new_dim: int) -> DataFrame:
    """The same elements, row by row, in rows of ``new_dim``. Widths that divide one another need no more than a regrouping of rows."""
    if new_dim <= 0 or dim <= 0:
        raise ValueError("widths must be positive")
    if dim % new_dim == 0:  # each row falls into whole new rows
        n = dim // new_dim
        parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("vector", i * new_dim + 1, new_dim))
        return rows.select("id", F.posexplode(parts).alias("p", "vector")).select((F.col("id") * n + F.col("p")).cast("bigint").alias("id"), "vector")
    cells = coordinates(rows).select((F.col("i") * dim + F.col("j")).alias("flat"), "v")
    return rows_of(cells.select(F.floor(F.col("flat") / new_dim).cast("bigint").alias("i"), (F.col("flat") % new_dim).alias("j"), "v"))


def element(rows: DataFrame, i: int, j: int) -> DataFrame:
    """(value) of row i, column j, from 0."""
    return rows.where(F.col("id") == i).select(F.col("vector")[j].alias("value"))


def with_element(vector: Column | str, j: int, value: Column) -> Column:
    """The vector with element j replaced."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x, i: F.when(i == j, value).otherwise(x))


def packed(vector: Column | str, n: int) -> Column:
    """A flat vector as an array of vectors of n elements; null where n does not divide its length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / n).cast("int") - 1), lambda i: F.slice(v, i * n + 1, n))
    return F.when((F.size(v) % n == 0) & (F.size(v) > 0), parts)


def unpacked(vector: Column | str) -> Column:
    return F.flatten(F.col(vector) if isinstance(vector, str) else vector)


@dataclass(frozen=True)
class Shape:
    rows: int
    dim: int
    item_bytes: int = 4

    @property
    def strides(self) -> tuple[int, int]:
        return self.dim, 1

    @property
    def elements(self) -> int:
        return self.rows * self.dim

    @property
    def bytes(self) -> int:
        return self.elements * self.item_bytes

    def size(self, axis: int) -> int:
        """The extent of an axis; negative numbers count from the end."""
        return (self.rows, self.dim)[axis]

    def is_contiguous(self) -> bool:
        return True


def shape_table(rows: DataFrame, item_bytes: int = 4) -> DataFrame:
    """One row: n, dim, n_elements, n_bytes, ragged."""
    a = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("bigint").alias("dim"), F.coalesce(F.min(F.size("vector")) < F.max(F.size("vector")), F.lit(False)).alias("ragged"))
    return a.select("n", "dim", (F.col("n") * F.col("dim")).alias("n_elements"), (F.col("n") * F.col("dim") * item_bytes).alias("n_bytes"), "ragged")


def shape(rows: DataFrame, item_bytes: int = 4) -> Shape:
    r = shape_table(rows, item_bytes).first()
    if r["ragged"]:
        raise ValueError("rows differ in length")
    return Shape(r["n"], r["dim"], item_bytes)


def same_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: same_rank (always true for matrices), same_sizes."""
    x, y = shape_table(a), shape_table(b).select(F.col("n").alias("n2"), F.col("dim").alias("dim2"), F.col("ragged").alias("ragged2"))
    both = x.join(y, F.lit(True))  # one row each
    return both.select(F.lit(True).alias("same_rank"), ((F.col("n") == F.col("n2")) & (F.col("dim") == F.col("dim2")) & ~F.col("ragged") & ~F.col("ragged2")).alias("same_sizes"))


def copied(rows: DataFrame) -> DataFrame:
    """A persisted copy: later changes of the source don't reach it once it is filled."""
    return rows.persist()
