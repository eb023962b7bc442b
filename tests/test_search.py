"""Search, selection, evaluation and the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions.integers import FLT_MAX
from vectide.functions.vectors import splat
from vectide.operators import evaluate, topk
from vectide.operators.index import IndexConfig, VectorIndex
from vectide.operators.knn import knn, knn_tiled, nearest


def frame(spark, x, id="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{id} bigint, vector array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:60] = base[0]  # ties
    queries = np.concatenate([base[:5], rng.normal(size=(20, 8)).astype(np.float32)])
    return base, queries, frame(spark, base).repartition(5).cache(), frame(spark, queries, "query_id").cache()


def brute(base, queries, k):
    d = ((queries.astype(float)[:, None] - base.astype(float)[None]) ** 2).sum(-1)
    order = [sorted(range(len(base)), key=lambda j: (row[j], j))[:k] for row in d]
    return {(q, r + 1): (j, d[q, j]) for q, js in enumerate(order) for r, j in enumerate(js)}


def result(df):
    return {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in df.collect()}


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


@pytest.mark.parametrize("k", [1, 7, 15, 300, 1024])
def test_knn_is_exact(data, k):
    base, queries, b, q = data
    same(result(knn(b, q, k)), brute(base, queries, k))


@pytest.mark.parametrize("options", [{"strategy": "sql"}, {"strategy": "sql", "form": "expanded"}, {"query_bytes": 200}, {"salts": 5}, {"strategy": "sql", "query_bytes": 300}])
def test_strategies_agree(data, options):
    base, queries, b, q = data
    want = brute(base, queries, 9)
    got = result(knn(b, q, 9, **options))
    if options.get("form"):  # the expansion may order exact ties by rounding
        assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    else:
        same(got, want)


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_relative_is_exact_less_the_own_norm(data, strategy):
    _, queries, b, q = data
    exact, relative = result(knn(b, q, 5, strategy=strategy)), result(knn(b, q, 5, exact=False, strategy=strategy))
    for key, (_, d) in relative.items():
        assert d == pytest.approx(exact[key][1] - (queries[key[0]].astype(float) ** 2).sum(), abs=1e-9)


def test_partitions_and_tiles_do_not_matter(data):
    base, queries, b, q = data
    want = brute(base, queries, 6)
    same(result(knn(b.repartition(1), q, 6)), want)
    same(result(knn(b.repartition(23), q, 6)), want)
    same(result(knn_tiled(b, q, 6, tile=32)), want)
    same({(r["query_id"], 1): (r["neighbor_id"], r["distance"]) for r in nearest(b, q).collect()}, brute(base, queries, 1))


def test_tiles_are_bounded(data, monkeypatch):
    """Distances come in tiles of so many bytes, however many queries there are; the neighbours are the same."""
    from vectide.operators import knn as module

    base, queries, _, _ = data
    monkeypatch.setattr(module, "TILE_BYTES", 8 * len(queries) * 3)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **o: (sizes.append(x.nbytes), partition(x, *a, **o))[1])
    take, done = module._nearest(queries.astype(float), 2)
    take(np.arange(len(base)), base.astype(float))
    q, i, d = done()
    got = {}
    for a, b, c in zip(q.tolist(), i.tolist(), d.tolist()):
        got[a, 1 + sum(x == a for x, _ in got)] = (b, c)
    same(got, brute(base, queries, 2))
    assert sizes and max(sizes) <= 8 * len(queries) * 3


def test_blocks_grow_with_queries_and_k(data):
    from vectide.operators import knn as module

    _, _, _, q = data
    assert len(module.query_blocks(q)) == 1 and len(module.query_blocks(q, 200)) == 8
    assert len(module.query_blocks(q, k=module.KEPT_BYTES // 1000)) == 3


def test_published_driver(spark):
    base = spark.range(1000).select("id", splat(F.least("id", F.lit(10)).cast("float"), 128).alias("vector"))
    one = spark.range(2).select(F.col("id").alias("query_id"), splat(F.lit(1.0).cast("float"), 128).alias("vector"))
    relative, exact = result(knn(base, one, 15, exact=False)), result(knn(base, one, 15))
    values = [-128, 0, 0, 384, 1024, 1920, 3072, 4480, 6144, 8064] + [10240] * 5
    ids = [1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    for q in (0, 1):
        assert [relative[q, r] for r in range(1, 16)] == list(zip(ids, values))
        assert [exact[q, r][1] for r in range(1, 16)] == [v + 128 for v in values]


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_odd_vectors_and_padding(spark, strategy):
    base = spark.createDataFrame([(0, [float("nan"), 0.0]), (1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [1e30, 1e30])], "id bigint, vector array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id bigint, vector array<float>")
    assert result(knn(base, q, 3, strategy=strategy)) == {(7, 1): (1, 1.0)}
    assert result(knn(base, q, 3, strategy=strategy, pad=True)) == {(7, 1): (1, 1.0), (7, 2): (-1, FLT_MAX), (7, 3): (-1, FLT_MAX)}
    assert result(knn(base.where("id < 0"), q, 2, strategy=strategy, pad=True)) == {(7, 1): (-1, FLT_MAX), (7, 2): (-1, FLT_MAX)}
    assert result(knn(base, q.where("query_id < 0"), 2, strategy=strategy)) == {}


def test_arguments_are_checked(data):
    _, _, b, q = data
    for bad in ({"k": 0}, {"k": 1, "strategy": "x"}, {"k": 1, "form": "x"}):
        with pytest.raises(ValueError):
            knn(b, q, **bad)


def test_rank_limit_reaches_below_the_shuffle(data):
    _, _, b, q = data
    plan = knn(b, q, 3, strategy="sql")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("form, exact", [("direct", True), ("direct", False), ("expanded", True)])
@pytest.mark.parametrize("dim", [3, 70, 120])
def test_sql_measures_only_pairs_within_reach(spark, monkeypatch, form, exact, dim):
    """The join leaves out most pairs by compiled products; neighbours, ties included, are those of all pairs."""
    from vectide.operators import knn as module

    rng = np.random.default_rng(dim)
    base = rng.normal(size=(600, dim)).astype(np.float32)
    base[100:140] = base[0]
    queries = base[:12].copy()
    queries[11] *= 1e3
    b, q = frame(spark, base).repartition(3), frame(spark, queries, "query_id")
    sides = b.select(F.col("id").alias("neighbor_id"), F.col("vector").alias("bv")), q.select("query_id", F.col("vector").alias("qv"))
    monkeypatch.setattr(module, "SHARE", 10**9)  # no bound
    every = result(knn(b, q, 4, exact, "sql", form))
    monkeypatch.setattr(module, "SHARE", 3)
    assert result(knn(b, q, 4, exact, "sql", form)) == every
    assert 12 * 4 <= module._near_pairs(*sides, 4, exact and form == "direct").count() < 12 * 600 / 4
    plan = knn(b, q, 4, exact, "sql", form)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "NestedLoopJoin" in line]
    assert any("reach" in line for line in joins) and not any("aggregate(" in line for line in joins)
    if exact and form == "direct":
        assert {x: v[0] for x, v in every.items()} == {x: v[0] for x, v in brute(base, queries, 4).items()}


def test_sql_reach_with_odd_vectors(spark, monkeypatch):
    from vectide.operators import knn as module

    monkeypatch.setattr(module, "SHARE", 1)
    nan, inf = float("nan"), float("inf")
    b = [[1e200, 1.0], [1e200, 2.0], [nan, 0.0], [inf, 0.0], [-inf, 1.0], [None, 1.0], None, [0.0, 0.0, 0.0], [], [1e-200, 0.0], [0.0, -0.0], [3e19, 0.0], [1.0, 2.0], [1e160, 0.0]]
    q = [[1e200, 1.0], [0.0, 0.0], [nan, 1.0], [inf, 0.0], [None, 0.0], [1.0, 2.0], [1e150, 0.0]]
    base = spark.createDataFrame(list(enumerate(b)), "id bigint, vector array<double>")
    queries = spark.createDataFrame(list(enumerate(q)), "query_id bigint, vector array<double>")

    def want(relative):
        out = {}
        for i, x in enumerate(q):
            found = []
            for j, y in enumerate(b):
                if y is None or len(y) != 2 or None in x or None in y:
                    continue
                with np.errstate(all="ignore"):
                    x_, y_ = np.array(x), np.array(y)
                    d = float((y_ * y_).sum() - 2.0 * (x_ * y_).sum() if relative else ((x_ - y_) ** 2).sum())
                if d < FLT_MAX:
                    found.append((d, j))
            out |= {(i, n + 1): (j, d) for n, (d, j) in enumerate(sorted(found)[:3])}
        return out

    assert result(knn(base, queries, 3, strategy="sql")) == want(False)
    assert result(knn(base, queries, 3, exact=False, strategy="sql")) == want(True)
    # queries of several lengths meet the vectors of their own
    mixed = queries.where("query_id = 1").unionAll(spark.createDataFrame([(9, [0.0, 0.0, 1.0])], "query_id bigint, vector array<double>"))
    assert result(knn(base, mixed, 1, strategy="sql")) == {(1, 1): (9, 0.0), (9, 1): (7, 1.0)}


def test_row_selection(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, float("nan"), 1.0, -2.0]), (2, [FLT_MAX, 5.0])], "id bigint, vector array<double>")
    rows = lambda **o: [tuple(r) for r in topk.select_rows(df, "id", "vector", 3, **o).orderBy("id", "rank").collect()]
    assert rows() == [(1, 1, 4, -2.0), (1, 2, 1, 1.0), (1, 3, 3, 1.0), (2, 1, 1, 5.0)]
    assert rows(largest=True, pad=True)[3:] == [(2, 1, 0, FLT_MAX), (2, 2, 1, 5.0), (2, 3, -1, -FLT_MAX)]
    with pytest.raises(ValueError):
        topk.select_rows(df, "id", "vector", 0)


def test_wide_and_long_are_inverse(data):
    _, _, b, q = data
    found = knn(b, q, 4)
    assert result(topk.long(topk.wide(found))) == result(found)


def test_recall_counts_repeats(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id bigint, neighbors array<bigint>")
    truth, found = lists([(0, [2, 3, 9]), (1, [1, 1, 2, 4]), (2, [5, 6, 7])]), lists([(0, [3, 1, 2]), (1, [1, 1, 1, 3]), (3, [5])])
    assert evaluate.recall(found, truth).first()[0] == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)
    assert {r[0]: r[1] for r in evaluate.recall_diff(found, truth).collect()} == {0: 1, 1: 2, 2: 3}
    assert evaluate.recall(truth, truth).first()[0] == 1.0
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "value bigint")
    assert sorted(r[0] for r in evaluate.intersect_all(v(1, 1, 2), v(1, 1, 1, 3)).collect()) == [1, 1]


def test_index(spark, data):
    base, queries, b, _ = data
    index = VectorIndex(spark, 8)
    assert index.is_trained and index.train() is index and index.count == 0
    assert (index.search_arrays(queries[:2], 2)[0] == -1).all()
    index.add(base[:100]).add(b.where("id >= 100").withColumn("id", F.col("id") - 100)).add(base[:0])
    assert index.count == 300
    ids, distances = index.search_arrays(queries, 4)
    want = brute(base, queries, 4)
    assert all(ids[q, r - 1] == j and distances[q, r - 1] == pytest.approx(d, abs=1e-9) for (q, r), (j, d) in want.items())
    assert index.reset().count == 0
    # a frame without ids is numbered in its order
    index.add(b.orderBy("id").select("vector"))
    assert (index.search_arrays(queries, 4)[0] == ids).all()
    index.add(b.orderBy("id").select(F.lit(1).alias("other"), "vector"))
    assert index.reset().count == 0
    with pytest.raises(ValueError):
        index.add(b.select(F.col("vector").alias("x"), F.lit(1).alias("y")))
    with pytest.raises(ValueError):
        index.add(base[:, :3])
    with pytest.raises(ValueError):
        index.add(b.select("id", F.slice("vector", 1, 3).alias("vector")))
    for bad in (lambda: VectorIndex(spark, 0), lambda: VectorIndex(spark, 3, IndexConfig(storage="tape"))):
        with pytest.raises(ValueError):
            bad()


def test_stream_of_queries(spark, data, tmp_path):
    from vectide.streaming.search import answer

    base, queries, b, q = data
    q.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    answer(stream, b, 3, lambda df, n: got.update(result(df)), str(tmp_path / "checkpoint")).awaitTermination()
    same(got, brute(base, queries, 3))


def test_numbered(spark):
    from vectide.runtime import numbered

    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).orderBy("x")
    assert {(r["x"], r["n"]) for r in numbered(rows, "n").collect()} == {(k, k) for k in range(1000)}
    assert numbered(rows.where("x < 0"), "n").count() == 0


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from vectide.runtime import shared_folder

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(far)
