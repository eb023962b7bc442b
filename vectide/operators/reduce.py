"""Reductions by group, and lane-wise operators on windows of 32 consecutive rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.integers import LANES, lane


def reduced(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total, least, greatest): sum (0 for none), minimum and maximum, combined before the shuffle."""
    return df.groupBy(group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def extreme_pairs(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, min_k, min_v, max_k, max_v): the smallest and largest (key, value) pair of each group, keys first."""
    p = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    g = df.groupBy(group).agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    return g.select(group, F.col("lo.k").alias("min_k"), F.col("lo.v").alias("min_v"), F.col("hi.k").alias("max_k"), F.col("hi.v").alias("max_v"))


def fold(array: Column | str, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """A reduction of an array by any operator with an identity."""
    return F.aggregate(array, start, op)


def _warp(id: str):
    return Window.partitionBy(F.floor(F.col(id) / LANES))


def shuffled(df: DataFrame, id: str, value: str, delta: int, xor: int, source: int = 0) -> DataFrame:
    """df with up, down, xor_value and from_lane: the value of the row ``delta`` before and after, at lane xor ``xor``, and of lane ``source``.

    Rows belong together in blocks of 32 ids; where there is no such lane in the block, the row keeps its own value.
    """
    w = _warp(id).orderBy(id)
    everyone = F.map_from_entries(F.collect_list(F.struct(lane(id), F.col(value))).over(_warp(id)))
    at = lambda n: F.coalesce(F.element_at("__lanes", n), F.col(value))
    out = df.withColumn("up", F.coalesce(F.lag(value, delta).over(w), F.col(value))).withColumn("down", F.coalesce(F.lead(value, delta).over(w), F.col(value)))
    out = out.withColumn("__lanes", everyone)
    return out.withColumn("xor_value", at(lane(id).bitwiseXOR(F.lit(xor).cast("bigint")))).withColumn("from_lane", at(F.lit(source).cast("bigint"))).drop("__lanes")


def votes(df: DataFrame, id: str, test: Column) -> DataFrame:
    """(warp, all_true, any_true, ballot, active): votes of each block of 32 ids; ballot and active are masks of lanes."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), lane(id).cast("int"))
    rows = df.select(F.floor(F.col(id) / LANES).cast("bigint").alias("warp"), test.alias("p"), bit.alias("bit"))
    return rows.groupBy("warp").agg(F.bool_and("p").alias("all_true"), F.bool_or("p").alias("any_true"), F.bit_or(F.when(F.col("p"), F.col("bit")).otherwise(0)).alias("ballot"), F.bit_or("bit").alias("active"))


def sorted_values(df: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    """A full sort by range partitioning."""
    return df.orderBy(*((F.col(k).desc() if descending else F.col(k).asc()) for k in keys))
