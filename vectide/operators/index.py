"""A brute-force vector index over a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import squared_norm
from vectide.operators.knn import knn
from vectide.runtime import numbered

# Where the vectors of an index are held.
STORAGE = {"memory": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK, "none": None}


@dataclass(frozen=True)
class IndexConfig:
    exact: bool = True
    storage: str = "memory_and_disk"
    strategy: str = "arrow"


class VectorIndex:
    """Holds base vectors with their norms and answers k-nearest-neighbour searches."""

    def __init__(self, spark: SparkSession, dimension: int, config: IndexConfig | None = None):
        config = config or IndexConfig()
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        if config.storage not in STORAGE:
            raise ValueError(f"unknown storage {config.storage}")
        self.spark, self.dimension, self.config = spark, dimension, config
        self._data: DataFrame | None = None
        self._n = 0
        self.is_trained = True

    def train(self, vectors: DataFrame | None = None) -> VectorIndex:
        """A brute-force index has nothing to learn."""
        return self

    def frame(self, vectors: DataFrame | np.ndarray, id: str) -> DataFrame:
        """(id, vector) of a matrix or of a frame; a frame without ids gets consecutive ones."""
        if isinstance(vectors, np.ndarray):
            x = np.ascontiguousarray(vectors, np.float32)
            if x.ndim != 2 or x.shape[1] != self.dimension:
                raise ValueError(f"vectors must have {self.dimension} columns")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            return self.spark.createDataFrame(pa.table({id: np.arange(len(x)), "vector": lists}))
        if id not in vectors.columns:
            if "vector" not in vectors.columns and len(vectors.columns) > 1:
                raise ValueError("a frame of several columns must name its vectors `vector`")
            column = "vector" if "vector" in vectors.columns else vectors.columns[0]
            return numbered(vectors.select(F.col(column).cast("array<float>").alias("vector")), id).select(F.col(id).cast("bigint").alias(id), "vector")
        return vectors.select(F.col(id).cast("bigint").alias(id), "vector")

    def add(self, vectors: DataFrame | np.ndarray) -> VectorIndex:
        """Adds vectors; ids go on from those there. Nothing happens for none."""
        new = self.frame(vectors, "id")
        checked = new.agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull() | (F.size("vector") != self.dimension)).alias("bad")).first()
        if checked["bad"]:
            raise ValueError(f"{checked['bad']} vectors are not of length {self.dimension}")
        if not checked["n"]:
            return self
        new = new.withColumn("id", F.col("id") + self._n).withColumn("norm2", squared_norm("vector"))
        data = new if self._data is None else self._data.unionByName(new)
        level = STORAGE[self.config.storage]
        before, self._data = self._data, data if level is None else data.persist(level)
        if before is not None and level is not None:
            self._data.count()
            before.unpersist()
        self._n += checked["n"]
        return self

    def search(self, queries: DataFrame | np.ndarray, k: int, pad: bool = False) -> DataFrame:
        """(query_id, rank, neighbor_id, distance) of the k nearest vectors of every query."""
        q = self.frame(queries, "query_id")
        base = self._data if self._data is not None else self.spark.createDataFrame([], "id bigint, vector array<float>, norm2 double")
        return knn(base, q, k, exact=self.config.exact, strategy=self.config.strategy, pad=pad)

    def search_arrays(self, queries: DataFrame | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours, distances) as matrices with a row per query, in order of their ids; short results are padded."""
        rows = self.search(queries, k, pad=True).orderBy("query_id", "rank").toPandas()
        return rows["neighbor_id"].to_numpy().reshape(-1, k), rows["distance"].to_numpy().reshape(-1, k)

    def reset(self) -> VectorIndex:
        if self._data is not None:
            self._data.unpersist()
        self._data, self._n = None, 0
        return self

    @property
    def count(self) -> int:
        return self._n

    @property
    def data(self) -> DataFrame | None:
        return self._data
