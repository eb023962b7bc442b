"""Exact k-nearest-neighbour search under squared L2 distance.

base(id, vector) and queries(query_id, vector) are DataFrames; the result is
(query_id, rank, neighbor_id, distance), ranked by (distance, id).

Strategy ``arrow`` (the default) multiplies blocks of base vectors with the query
matrix and keeps the best k of each query per task, so a task sends k rows a
query however much of the base it reads. Candidates within rounding reach of the
k-th are measured again by the sum of squared differences, so ties and order
agree with strategy ``sql``, which states the same as expressions and lets
Catalyst push the rank limit below the shuffle (WindowGroupLimit).

Higher-order functions are interpreted element by element, so strategy ``sql``
leaves to them only the pairs that can matter. A hashed share of the base gives each
query an upper bound of its k-th distance; then every base vector meets every query
in the condition of one nested loop join, a sum of products written out by element
that Spark compiles. A pair is left out if it lies beyond the bound by more than
rounding can account for; the others are measured by the form asked for and ranked.

The queries travel to the base, never the other way. Their size is counted first:
beyond ``query_bytes`` they are dealt into blocks. These are searched one after the
other, each written before the next is read, so neither a broadcast nor what the
driver holds outgrows that bound. A tile of distances has TILE_BYTES at most,
whatever the number of queries in a block, and the candidates that a task keeps
have KEPT_BYTES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.integers import FLT_MAX
from vectide.functions.vectors import expanded_distance, relative_distance, squared_distance, squared_norm
from vectide.operators.topk import admissible, first, padded, ranked
from vectide.runtime import saved

QUERY_BYTES = 32 << 20
#: Base vectors whose distances to all queries of a block are worked out at once, and what these may take.
ROWS, TILE_BYTES = 1024, 32 << 20
#: What the best candidates of all queries of a block may take in a task.
KEPT_BYTES = 256 << 20
#: Tiles of base vectors of which a task keeps the best apart at once.
TILES = 16
#: One base vector of so many, by hash of its id, bounds the distances of strategy ``sql``.
SHARE = 32
#: Share of both norms that products may be off by; from squared norms of BIG on they may overflow, so such pairs are always measured.
SLACK, BIG = 1e-9, 1e280
#: Elements whose products one method holds within the 8000 bytes that the JVM compiles; above these Spark deals them over methods,
#: and beyond MOST every pair is measured.
INLINE, MOST = 96, 1024


def query_blocks(queries: DataFrame, limit: int = QUERY_BYTES, k: int = 1) -> list[DataFrame]:
    """The queries in parts of about ``limit`` bytes, by hash of their id; fewer a part where k is large."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("bigint") * 8), F.lit(0))).first()
    parts = max(1, -(-int(size) // limit), -(-n * k * 120 // KEPT_BYTES))  # five candidates of 24 bytes for each one that stays
    return [queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; all must be of one length, without nulls."""
    n = len(vectors)
    sizes = pa.compute.list_value_length(vectors)
    if vectors.null_count or n and pa.compute.min_max(sizes)["min"].as_py() != pa.compute.min_max(sizes)["max"].as_py():
        raise ValueError("vectors must be present and of one length")
    flat = vectors.flatten()
    if flat.null_count:
        raise ValueError("vectors must not hold nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _nearest(query: np.ndarray, k: int):
    """A function that takes (ids, base matrix) blocks and, at the end, gives (query number, id, squared distance) of the best k."""
    norm = (query * query).sum(axis=1)
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    worst = np.full(len(query), np.inf)

    def prune() -> None:
        q, i, d = kept
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept[:] = [x[place < k] for x in (q, i, d)]
        last = place == k - 1
        worst[q[last]] = d[last]

    rows = max(1, min(ROWS, TILE_BYTES // (8 * max(1, len(query)))))

    def take(ids: np.ndarray, base: np.ndarray) -> None:
        for at in range(0, len(ids), rows):
            tile(ids[at : at + rows], base[at : at + rows])

    def tile(ids: np.ndarray, base: np.ndarray) -> None:
        ok = np.isfinite(base).all(axis=1)  # NaN and infinite distances are never selected
        ids, base = ids[ok], base[ok]
        if not len(ids):
            return
        own = (base * base).sum(axis=1)
        d = own[None, :] - 2.0 * (query @ base.T) + norm[:, None]
        reach = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.inf)
        # within 1e-9 * (norm + own) of the reach
        d -= 1e-9 * own[None, :]
        q, b = np.nonzero(d <= (reach + 1e-9 * norm)[:, None])
        exact = np.concatenate([((query[q[s : s + 65536]] - base[b[s : s + 65536]]) ** 2).sum(axis=1) for s in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        fits = exact < FLT_MAX
        kept[:] = [np.concatenate(x) for x in zip(kept, (q[fits], ids[b[fits]], exact[fits]), strict=True)]
        if len(kept[0]) > 4 * k * len(query) + 65536 or np.isinf(worst).any():
            prune()

    def done() -> tuple[np.ndarray, ...]:
        prune()
        return tuple(kept)

    return take, done


def _best_of_tasks(base: DataFrame, queries: DataFrame, k: int, tile: int | None = None) -> tuple[DataFrame, DataFrame, Broadcast]:
    """((q, neighbor_id, d2) of the best k of each query in each task, (q, query_id, own norm) of the queries, the broadcast they travel in).

    tile: the best k of each tile of so many consecutive ids, as (q, tile, local_id, d2).
    """
    import pyarrow.compute  # noqa: F401

    spark = base.sparkSession
    found = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vector").toArrow()  # bounded by query_blocks()
    ids = found["query_id"].to_numpy()
    query = matrix(found["vector"].combine_chunks()) if len(ids) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(query)
    names = ["q", "neighbor_id", "d2"] if tile is None else ["q", "tile", "local_id", "d2"]
    schema = pa.schema([(x, pa.float64() if x == "d2" else pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        open_: dict[int, tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for number, (_, done) in open_.items():
                q, i, d = done()
                columns = (q, i, d) if tile is None else (q, np.full(len(q), number), i, d)
                for at in range(0, len(q), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], schema=schema)
            open_.clear()

        for rb in batches if len(shared.value) else ():
            for at in range(0, rb.num_rows, ROWS):
                part = rb.slice(at, ROWS)
                i, v = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                of = np.zeros(len(i), np.int64) if tile is None else i // tile
                for number in np.unique(of).tolist():
                    if number not in open_ and len(open_) == TILES:
                        yield from flush()
                    if number not in open_:
                        open_[number] = _nearest(shared.value, k)
                    mine = of == number
                    open_[number][0](i[mine] if tile is None else i[mine] % tile, v[mine])
        yield from flush()

    local = base.select(F.col("id").cast("bigint").alias("id"), "vector").mapInArrow(run, ", ".join(f"{x} {'double' if x == 'd2' else 'bigint'}" for x in names))
    return local, spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": pa.array(ids, pa.int64()), "own": (query * query).sum(axis=1)})), shared


def _knn_arrow(base: DataFrame, queries: DataFrame, k: int, exact: bool, salts: int) -> tuple[DataFrame, Broadcast]:
    local, names, shared = _best_of_tasks(base, queries, k)
    if salts > 1:  # k rows a task and query of very many tasks meet in two steps
        local = ranked(local.withColumn("salt", F.pmod(F.xxhash64("neighbor_id"), F.lit(salts))), ["q", "salt"], "d2", "neighbor_id", k).drop("rank", "salt")
    best = ranked(local, "q", "d2", "neighbor_id", k)
    distance = F.col("d2") if exact else F.col("d2") - F.col("own")
    return best.join(F.broadcast(names), "q").select("query_id", "rank", "neighbor_id", distance.alias("distance")), shared  # a row per query of the block


def _one_by_one(blocks: list[DataFrame], search: Callable[[DataFrame], tuple[DataFrame, Broadcast | None]]) -> DataFrame:
    """The union of a search of each block. Of several, each is written and its broadcast gone before the next begins."""
    out = None
    for block in blocks:
        part, shared = search(block)
        if len(blocks) > 1:
            part = saved(part, "block")
            if shared is not None:
                shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def _products(dim: int) -> Column:
    """The dot product of the elements b0, b1, ... and q0, q1, ..., in four sums that don't wait for each other."""
    sums = ["(" + " + ".join(f"b{j} * q{j}" for j in range(i, dim, 4)) + ")" for i in range(min(4, dim))]
    return F.expr(" + ".join(sums) if sums else "0.0D")


def _elements(vector: str, letter: str, dim: int) -> list[Column]:
    return [F.coalesce(F.get(vector, F.lit(j)).cast("double"), F.lit(0.0)).alias(f"{letter}{j}") for j in range(dim)]


def _near_pairs(b: DataFrame, q: DataFrame, k: int, direct: bool) -> DataFrame:
    """The pairs of b(neighbor_id, bv, ...) and q(query_id, qv) but for those that can't be among the k nearest.

    direct: squared distances are ranked, otherwise these less the query's own norm. Vectors with null or
    NaN elements, and pairs of unequal length, have no distance. Queries of several lengths get all pairs.
    """
    low, high = q.agg(F.min(F.size("qv")), F.max(F.size("qv"))).first()
    if low is None or low != high or high > MOST:
        return b.crossJoin(F.broadcast(q))  # bounded by query_blocks()
    if high <= INLINE:  # Spark compiles a join of so many columns only if told to
        conf, fields = b.sparkSession.conf, 2 * INLINE + 24
        conf.set("spark.sql.codegen.maxFields", str(max(fields, int(conf.get("spark.sql.codegen.maxFields")))))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    # The norm is a higher-order function, so this projection is apart from the join's method, which then only reads doubles.
    left = b.where(F.size("bv") == high).select("*", F.coalesce(squared_norm("bv"), nan).alias("bn"), *_elements("bv", "b", high)).where(F.col("bn") <= inf)
    right = q.select("*", F.coalesce(squared_norm("qv"), nan).alias("qn"), *_elements("qv", "q", high)).where(F.col("qn") <= inf)
    own = F.col("qn") * (1.0 if direct else 0.0)
    dot = _products(high)

    some = left.where((F.pmod(F.xxhash64("neighbor_id"), F.lit(SHARE)) == 0) & (F.col("bn") < BIG)).select((F.col("bn") * (1 + SLACK)).alias("bn"), *(f"b{j}" for j in range(high)))
    most = right.where(F.col("qn") < BIG).select("query_id", (own + F.col("qn") * SLACK).alias("more"), *(f"q{j}" for j in range(high)))
    seen = some.crossJoin(F.broadcast(most)).select("query_id", (F.col("bn") - 2.0 * dot + F.col("more")).alias("upper"))  # bounded by query_blocks()
    kth = first(seen, ["query_id"], [F.col("upper").asc()], k).where(F.col("rank") == k).select("query_id", "upper")

    reach = F.coalesce(F.col("upper") - own + (2 * SLACK * F.col("qn") + 1e-300), inf)
    right = right.join(F.broadcast(kth), "query_id", "left").withColumns({"reach": reach, "q_big": F.col("qn") >= BIG})  # a row per query of the block
    left = left.withColumns({"less": F.col("bn") * (1 - SLACK), "b_big": F.col("bn") >= BIG})
    near = left.crossJoin(F.broadcast(right)).where(F.col("b_big") | F.col("q_big") | (F.col("less") - 2.0 * dot <= F.col("reach")))  # bounded by query_blocks()
    # The generator keeps what follows from merging with this projection: else the join's method writes out all elements and grows too large for the JVM to compile.
    return near.select("query_id", F.inline(F.array(F.struct("neighbor_id", "qv", "bv", *(["norm2"] if "norm2" in b.columns else [])))))


def _knn_sql(base: DataFrame, queries: DataFrame, k: int, exact: bool, form: str) -> DataFrame:
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").alias("qv"))
    b = base.select(F.col("id").cast("bigint").alias("neighbor_id"), F.col("vector").alias("bv"), *(["norm2"] if "norm2" in base.columns else []))
    if form == "direct" and exact:
        distance: Column = squared_distance("qv", "bv")
    else:
        distance = relative_distance("qv", "bv", F.col("norm2") if "norm2" in base.columns else None)
    pairs = _near_pairs(b, q, k, form == "direct" and exact).select("query_id", "neighbor_id", F.coalesce(distance, F.lit(float("nan"))).alias("distance"))
    # NaN and infinite distances come last and go then: a filter on distances before would move into the join and be worked out there for every pair.
    best = first(pairs, ["query_id"], [F.col("distance").asc(), F.col("neighbor_id").asc()], k).where(admissible(F.col("distance")))
    if form == "expanded" and exact:  # the query's own norm is added to k rows a query, not to all
        own = F.broadcast(q.select("query_id", squared_norm("qv").alias("own")))
        best = best.join(own, "query_id").withColumn("distance", F.greatest(F.lit(0.0), F.col("distance") + F.col("own")))
    return best.select("query_id", "rank", "neighbor_id", "distance")


#: Inputs below so many bytes a core are dealt out before all-pairs work; larger scans have splits enough.
SMALL_BYTES = 16 << 20
#: Bytes of a base whose tasks' rows meet in one step; a larger one gets a step between.
ONE_STEP_BYTES = 256 << 30


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of df; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: all-pairs work on a small file would run in the one task that scans it. Large inputs are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if plan_bytes(df) < n * SMALL_BYTES else df


def knn(base: DataFrame, queries: DataFrame, k: int, exact: bool = True, strategy: str = "arrow", form: str = "direct", pad: bool = False, query_bytes: int = QUERY_BYTES, salts: int | None = None) -> DataFrame:
    """The k nearest base vectors of every query.

    exact: distances are squared L2; otherwise they lack the query's own norm (they rank alike and may
    be negative). form, for strategy ``sql``: ``direct`` or ``expanded``. pad: with fewer than k base
    vectors the missing ranks are (-1, FLT_MAX), otherwise they are absent. salts: groups in which the
    tasks' best rows meet before they meet per query; by the size of the base if not given.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if strategy not in ("arrow", "sql") or form not in ("direct", "expanded"):
        raise ValueError("unknown strategy or form")
    salts = salts or 1 + min(255, plan_bytes(base) // ONE_STEP_BYTES)
    base = spread(base)
    out = _one_by_one(query_blocks(queries, query_bytes, k), lambda block: _knn_arrow(base, block, k, exact, salts) if strategy == "arrow" else (_knn_sql(base, block, k, exact, form), None))
    return padded(out, queries.select(F.col("query_id").cast("bigint").alias("query_id")), k) if pad else out


def nearest(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, neighbor_id, distance) of the single nearest base vector: the best of each task, then one hash aggregate."""
    base = spread(base)

    def search(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        local, names, shared = _best_of_tasks(base, block, 1)
        best = local.groupBy("q").agg(F.min(F.struct("d2", "neighbor_id")).alias("p"))
        return best.join(F.broadcast(names), "q").select("query_id", "p.neighbor_id", F.col("p.d2").alias("distance")), shared  # a row per query of the block

    return _one_by_one(query_blocks(queries), search)


def knn_tiled(base: DataFrame, queries: DataFrame, k: int, tile: int) -> DataFrame:
    """knn() in two levels: the best k of every tile of ``tile`` consecutive ids, numbered within it, then the best k of all."""
    base = spread(base)

    def search(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        local, names, shared = _best_of_tasks(base, block, k, tile)
        first = ranked(local, ["q", "tile"], "d2", "local_id", k).drop("rank")  # a tile's rows may be with several tasks
        second = ranked(rebased(first, "local_id", "tile", tile).withColumnRenamed("local_id", "neighbor_id"), "q", "d2", "neighbor_id", k)
        return second.join(F.broadcast(names), "q").select("query_id", "rank", "neighbor_id", F.col("d2").alias("distance")), shared  # a row per query of the block

    return _one_by_one(query_blocks(queries, k=k * TILES), search)


def rebased(df: DataFrame, local_id: str, tile: str, size: int) -> DataFrame:
    """df with numbers within tiles turned into numbers of the whole."""
    return df.withColumn(local_id, (F.col(local_id) + F.col(tile) * size).cast("bigint"))
