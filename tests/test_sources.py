"""The xvecs source and sink, data sets, and the driver contract."""

import struct

import numpy as np
import pytest

from vectide.sources import datasets, xvecs


def write(path, rows, code, junk=b""):
    with open(path, "wb") as f:
        for r in rows:
            f.write(struct.pack("<i", len(r)) + np.asarray(r, code).tobytes())
        f.write(junk)
    return str(path)


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    xvecs.register(spark)


def read(spark, path, **options):
    return {r["id"]: r["vector"] for r in spark.read.format("xvecs").options(**options).load(path).collect()}


@pytest.mark.parametrize("split", [1, 40, 1 << 20])
def test_read_in_splits(spark, tmp_path, split):
    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    path = write(tmp_path / "a.fvecs", x, "<f4", junk=b"\1\2")
    assert read(spark, path, splitBytes=split) == {i: r.tolist() for i, r in enumerate(x)}


def test_read_integers_and_file_uris(spark, tmp_path):
    path = write(tmp_path / "a.ivecs", [[1, -2], [3, 4]], "<i4")
    df = spark.read.format("xvecs").load("file://" + path)
    assert df.schema.simpleString() == "struct<id:bigint,vector:array<int>>"
    assert {r["id"]: r["vector"] for r in df.collect()} == {0: [1, -2], 1: [3, 4]}


def test_bad_and_empty_files(spark, tmp_path):
    with pytest.raises(Exception, match="different lengths"):
        read(spark, write(tmp_path / "b.fvecs", [[1.0, 2.0], [1.0], [5.0]], "<f4"))
    assert read(spark, write(tmp_path / "e.fvecs", [], "<f4")) == {}
    with pytest.raises(Exception, match="No such|not found|FileNotFound|missing"):
        read(spark, str(tmp_path / "missing.fvecs"))


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "array(cast(id as float), cast(id * 2 as float)) as vector")
    path = str(tmp_path / "out.fvecs")
    for _ in range(2):
        df.repartitionByRange(4, "id").sortWithinPartitions("id").write.format("xvecs").mode("overwrite").save(path)
    assert read(spark, path) == {i: [float(i), float(2 * i)] for i in range(50)}


def test_data_set(spark, tmp_path):
    rng = np.random.default_rng(0)
    base, queries = rng.normal(size=(60, 6)).astype(np.float32), rng.normal(size=(4, 6)).astype(np.float32)
    d = ((queries[:, None].astype(float) - base[None].astype(float)) ** 2).sum(-1)
    write(tmp_path / "sift_base.fvecs", base, "<f4")
    write(tmp_path / "sift_query.fvecs", queries, "<f4")
    write(tmp_path / "sift_groundtruth.ivecs", np.argsort(d, axis=1)[:, :5], "<i4")
    data = datasets.load_sift(spark, str(tmp_path))
    assert tuple(data.info().first()) == (6, 60, 4, 5)
    assert data.recall(data.found()).first()[0] == 1.0
    assert {r["diff"] for r in data.recall_diff(data.found()).collect()} == {0}


def test_contract(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "neighbor_id", "distance"] and df.count() == 250


@pytest.mark.parametrize("name", ["knn_l2_exact", "knn_padded", "knn_empty_base", "knn_two_level", "row_topk_labeled", "gemm_alpha_beta", "gemm_ttt", "matrix_transpose", "row_products", "same_sizes", "set_intersection", "full_sort", "random_matrix_moments", "dataset_files", "dataset_sift", "dataset_gist", "index_life", "index_search_arrays", "recall_at_k", "reshape_view_wider", "bit_helpers", "warp_shuffle", "xvecs_scan"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(e.oracle_sql()[name]).df()
    got = e.queries()[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))
