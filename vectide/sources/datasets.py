"""Benchmark data sets: base vectors, queries and their true neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators import evaluate
from vectide.operators.knn import knn
from vectide.operators.topk import wide
from vectide.sources.xvecs import register


@dataclass
class Dataset:
    """base(id, vector), queries(query_id, vector) and truth(query_id, neighbors)."""

    name: str
    base: DataFrame
    queries: DataFrame
    truth: DataFrame

    def info(self) -> DataFrame:
        """One row: dim, n_base, n_queries, truth_k."""
        b = self.base.agg(F.count("*").alias("n_base"), F.max(F.size("vector")).cast("bigint").alias("dim"))
        q = self.queries.agg(F.count("*").alias("n_queries"))
        t = self.truth.agg(F.max(F.size("neighbors")).cast("bigint").alias("truth_k"))
        return b.join(q, F.lit(True)).join(t, F.lit(True)).select("dim", "n_base", "n_queries", "truth_k")  # one row each

    def found(self, k: int | None = None) -> DataFrame:
        """(query_id, neighbors) of an exact search, k being the truth's by default."""
        k = k or self.info().first()["truth_k"]
        return wide(knn(self.base, self.queries, k)).select("query_id", "neighbors")

    def recall(self, found: DataFrame) -> DataFrame:
        return evaluate.recall(found, self.truth)

    def recall_diff(self, found: DataFrame) -> DataFrame:
        return evaluate.recall_diff(found, self.truth)


def from_frames(name: str, base: DataFrame, queries: DataFrame, truth: DataFrame) -> Dataset:
    """A data set of frames that are there already."""
    return Dataset(name, base, queries, truth)


def load(spark: SparkSession, name: str, folder: str) -> Dataset:
    """The three files {name}_base.fvecs, {name}_query.fvecs and {name}_groundtruth.ivecs of a folder."""
    register(spark)
    read = lambda x: spark.read.format("xvecs").load(f"{folder.rstrip('/')}/{name}_{x}")
    queries, truth = read("query.fvecs"), read("groundtruth.ivecs")
    return Dataset(name, read("base.fvecs"), queries.withColumnRenamed("id", "query_id"), truth.select(F.col("id").alias("query_id"), F.transform("vector", lambda x: x.cast("bigint")).alias("neighbors")))


def load_sift(spark: SparkSession, folder: str) -> Dataset:
    return load(spark, "sift", folder)


def load_gist(spark: SparkSession, folder: str) -> Dataset:
    return load(spark, "gist", folder)
