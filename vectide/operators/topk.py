"""Row-wise and grouped k-selection with fixed tie rules.

Order is (value, label) ascending, or value descending and label ascending for
the largest. NaN and values at or beyond the sentinel are never selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.integers import FLT_MAX


def admissible(value: Column, largest: bool = False) -> Column:
    """Whether a value may be selected at all."""
    return value.isNotNull() & ~F.isnan(value) & ((value > -FLT_MAX) if largest else (value < FLT_MAX))


def ranked(df: DataFrame, group: str | list[str], value: str, label: str, k: int, largest: bool = False) -> DataFrame:
    """df's best k rows of each group with their ``rank`` (1 is best). The limit reaches both sides of the shuffle (WindowGroupLimit)."""
    if k <= 0:
        raise ValueError("k must be positive")
    group = [group] if isinstance(group, str) else group
    order = [F.col(value).desc() if largest else F.col(value).asc(), F.col(label).asc()]
    return first(df.where(admissible(F.col(value).cast("double"), largest)), group, order, k)


def first(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """df's first k rows of each group with their ``rank``, whatever their values."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def best(df: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """(group, value, label) of the smallest pair of each group: a hash aggregate without sorting."""
    ok = df.where(admissible(F.col(value).cast("double")))
    return ok.groupBy(group).agg(F.min(F.struct(value, label)).alias("p")).select(group, F.col(f"p.{value}").alias(value), F.col(f"p.{label}").alias(label))


def select_rows(df: DataFrame, row: str, vector: str, k: int, largest: bool = False, labels: str | None = None, pad: bool = False) -> DataFrame:
    """(row, rank, label, value): the best k elements of each row's vector.

    Labels are places from 0 or, with ``labels``, those of that array. The selection is local to a
    row, so nothing is shuffled. pad: missing ranks get label -1 and the sentinel value.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    label = (lambda i: F.col(labels)[i].cast("bigint")) if labels else (lambda i: i.cast("bigint"))
    sign = -1.0 if largest else 1.0
    cells = F.transform(F.col(vector), lambda v, i: F.struct((sign * v.cast("double")).alias("v"), label(i).alias("label")))
    cells = F.filter(cells, lambda c: c["v"].isNotNull() & ~F.isnan(c["v"]) & (c["v"] < FLT_MAX))
    cells = F.slice(F.array_sort(cells), 1, k)
    if pad:
        filler = F.array_repeat(F.struct(F.lit(FLT_MAX).alias("v"), F.lit(-1).cast("bigint").alias("label")), k)
        cells = F.slice(F.concat(cells, filler), 1, k)
    out = df.select(row, F.posexplode(cells).alias("i", "c"))
    return out.select(row, (F.col("i") + 1).cast("bigint").alias("rank"), F.col("c.label").alias("label"), (F.col("c.v") * sign).alias("value"))


def padded(found: DataFrame, queries: DataFrame, k: int, distance: str = "distance") -> DataFrame:
    """found(query_id, rank, neighbor_id, distance) with all ranks 1..k of every query: what is missing is (-1, FLT_MAX)."""
    ranks = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rank")
    grid = queries.select("query_id", ranks)
    full = grid.join(found, ["query_id", "rank"], "left")
    return full.select("query_id", "rank", F.coalesce("neighbor_id", F.lit(-1).cast("bigint")).alias("neighbor_id"), F.coalesce(distance, F.lit(FLT_MAX)).alias(distance))


def wide(found: DataFrame) -> DataFrame:
    """(query_id, neighbors, distances): one row a query, arrays in rank order."""
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "distance"))).alias("r"))
    return rows.select("query_id", F.col("r.neighbor_id").alias("neighbors"), F.col("r.distance").alias("distances"))


def long(found: DataFrame) -> DataFrame:
    """The inverse of :func:`wide`."""
    return found.select("query_id", F.posexplode(F.arrays_zip("neighbors", "distances")).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("x.neighbors").alias("neighbor_id"), F.col("x.distances").alias("distance"))
