"""Multiset intersection and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of both one-column frames, each as often as in the one that has it less often."""
    return a.intersectAll(b)


def counted(rows: DataFrame, array: str, count: str) -> DataFrame:
    """(query_id, value, count) of rows(query_id, array)."""
    return rows.select("query_id", F.explode(array).alias("value")).groupBy("query_id", "value").agg(F.count("*").alias(count))


def hits(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hits, truth_k) for every query of truth(query_id, neighbors): the size of the multiset intersection with found(query_id, neighbors).

    Values are counted per query before they meet, so repeated ids need no row numbers; queries without hits stay.
    """
    both = counted(truth, "neighbors", "t").join(counted(found, "neighbors", "f"), ["query_id", "value"])
    n = both.groupBy("query_id").agg(F.sum(F.least("t", "f")).alias("hits"))
    sizes = truth.select("query_id", F.size("neighbors").cast("bigint").alias("truth_k"))
    return sizes.join(n, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "truth_k")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall, the mean over queries of hits / size of the truth."""
    return hits(found, truth).agg(F.avg(F.col("hits") / F.col("truth_k")).alias("recall"))


def recall_diff(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, diff): neighbours of the truth that were not found."""
    return hits(found, truth).select("query_id", (F.col("truth_k") - F.col("hits")).alias("diff"))


def membership(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows (query_id, neighbor_id) of found that truth has too, as a semi-join."""
    return found.join(truth, ["query_id", "neighbor_id"], "left_semi")
