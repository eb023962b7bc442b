"""Vector and integer functions, matrices, views, reductions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import integers as K
from vectide.functions import strings as S
from vectide.functions import vectors as V
from vectide.operators import linalg, reduce, tensor


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.array(*(F.lit(float(v)) for v in x))


@pytest.mark.parametrize(("make", "want"), [
    (lambda a, b: V.add(a, b), [5.0, -3.0, 3.5]),
    (lambda a, b: V.subtract(2.0, a), [1.0, 4.0, 1.5]),
    (lambda a, b: V.multiply(a, V.scalar(2)), [2.0, -4.0, 1.0]),
    (lambda a, b: V.divide(a, lit([0, 0, 2])), [math.inf, -math.inf, 0.25]),
    (lambda a, b: V.minimum(a, b), [1.0, -2.0, 0.5]),
    (lambda a, b: V.maximum(a, 0.0), [1.0, 0.0, 0.5]),
    (lambda a, b: V.clamp(a, -1.0, 0.75), [0.75, -1.0, 0.5]),
    (lambda a, b: V.clamp(a, lit([2, 0, 0]), lit([3, 1, 1])), [2.0, 0.0, 0.5]),
    (lambda a, b: V.lerp(a, b, 0.5), [2.5, -1.5, 1.75]),
    (lambda a, b: V.frac(lit([-1.25, 1.25, 2])), [0.75, 0.25, 0.0]),
    (lambda a, b: V.fmod(lit([-7.5, 7.5, 1]), 2.0), [-1.5, 1.5, 1.0]),
    (lambda a, b: V.floor(lit([-1.5, 1.5, 2])), [-2.0, 1.0, 2.0]),
    (lambda a, b: V.smoothstep(0.0, 1.0, lit([-1, 0.5, 2])), [0.0, 0.5, 1.0]),
    (lambda a, b: V.cross(a, b), [-5.5, -1.0, 7.0]),
    (lambda a, b: V.reflect(a, lit([0, 1, 0])), [1.0, 2.0, 0.5]),
    (lambda a, b: V.normalized(lit([3, 4, 0])), [0.6, 0.8, 0.0]),
    (lambda a, b: V.widened(V.truncated(a, 2), 9.0), [1.0, -2.0, 9.0]),
    (lambda a, b: V.to_uint(V.to_int(lit([-1.9, 2.9, 0]))), [4294967295, 2, 0]),
])
def test_vector_functions(spark, make, want):
    assert value(spark, make(lit([1, -2, 0.5]), lit([4, -1, 3]))) == pytest.approx(want)


def test_nan_rules(spark):
    nan = float("nan")
    assert value(spark, V.minimum(lit([nan, 1]), lit([2, nan])))[0] == 2.0 and math.isnan(value(spark, V.minimum(lit([nan, 1]), lit([2, nan])))[1])
    assert math.isnan(value(spark, V.divide(lit([0]), 0.0))[0])
    assert value(spark, V.normalized(lit([0, 0]))) == [None, None]


vectors = st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(vectors)
def test_distances_agree(spark, a):
    b = [x / 2 + 1 for x in a]
    want = sum((x - y) ** 2 for x, y in zip(a, b))
    got = spark.range(1).select(V.squared_distance(lit(a), lit(b)), V.expanded_distance(lit(a), lit(b)), V.relative_distance(lit(a), lit(b)) + V.squared_norm(lit(a)), V.dot(lit(a), lit(b))).first()
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want, abs=1e-6) and got[2] == pytest.approx(want, abs=1e-6)
    assert got[3] == pytest.approx(sum(x * y for x, y in zip(a, b)))


def test_integer_functions(spark):
    cases = [
        (K.div_up(7, 2), 4), (K.round_up(7, 4), 8), (K.round_down(7, 4), 4), (K.log2_floor(1), 0), (K.log2_floor(31), 4), (K.log2_floor(32), 5), (K.log2_floor(0), 0),
        (K.is_power_of_2(0), False), (K.is_power_of_2(64), True), (K.is_power_of_2(65), False),
        (K.next_power_of_2(2), 4), (K.next_power_of_2(3), 4), (K.next_power_of_2(16), 32), (K.next_power_of_2(1), 2),
        (K.get_bits(0b101100, 2, 3), 0b011), (K.set_bits(0b111111, 0, 1, 2), 0b111001), (K.popcount(255), 8), (K.round_half_away(F.lit(-2.5)), -3), (K.round_half_away(F.lit(2.5)), 3),
        (K.lane(33), 1), (K.lane_masks(1)["lt"], 1), (K.lane_masks(1)["le"], 3), (K.lane_masks(31)["gt"], 0), (K.lane_masks(0)["ge"], 4294967295), (K.choose(F.lit(True), F.lit(1), F.lit(2)), 1),
        (S.delimiter_end(F.lit("--name"), "-"), 2), (S.delimiter_end(F.lit("--n"), "-"), 0), (S.delimiter_end(F.lit("name"), "-"), 0),
        (S.file_extension(F.lit("a.b.fvecs")), "fvecs"), (S.file_extension(F.lit("none")), None),
    ]
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(got) == [w for _, w in cases]


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i bigint, j bigint, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for i, j, v in df.select("i", "j", "v").collect():
        out[i, j] += v
    return out


@pytest.mark.parametrize("flags", [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
def test_gemm(spark, flags):
    rng = np.random.default_rng(5)
    ta, tb, tc = map(bool, flags)
    a, b, c = rng.normal(size=(3, 4)), rng.normal(size=(4, 2)), rng.normal(size=(3, 2))
    got = linalg.gemm(cells(spark, a.T if ta else a), cells(spark, b.T if tb else b), cells(spark, c.T if tc else c), ta, tb, tc, alpha=-2.0, beta=1.0)
    want = -2.0 * a @ b + c
    assert dense(got, want.T.shape if tc else want.shape) == pytest.approx(want.T if tc else want)


def test_row_products_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(20, 5)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vector array<float>")
    for size in (1 << 20, 100):
        assert dense(linalg.row_products(rows, rows, b_bytes=size), (20, 20)) == pytest.approx(x.astype(float) @ x.T.astype(float), abs=1e-9)


@pytest.mark.parametrize(("n", "dim"), [(1, 1), (7, 3), (33, 100), (10, 1088)])
def test_norm_driver(spark, n, dim):
    ones = linalg.constant(spark, n, dim, 1.0)
    assert {r["norm"] for r in linalg.norms(ones).collect()} == {float(dim)}
    assert {r["norm"] for r in linalg.norms(ones, squared=False).collect()} == {math.sqrt(dim)}


def test_gaussian(spark):
    x = np.array([r["vector"] for r in linalg.gaussian(spark, 2000, 4, mean=1.0, stddev=2.0, seed=3).collect()])
    assert x.shape == (2000, 4) and abs(x.mean() - 1) < 0.1 and abs(x.std() - 2) < 0.1 and len(np.unique(x)) > 7000


@pytest.mark.parametrize("new", [1, 2, 3, 4, 6, 12])
def test_reshape(spark, new):
    x = np.arange(24.0).reshape(4, 6)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vector array<double>")
    got = {r["id"]: r["vector"] for r in tensor.reshape(rows, 6, new).collect()}
    assert np.array([got[i] for i in range(24 // new)]).tolist() == x.reshape(-1, new).tolist()


def test_views(spark):
    rows = linalg.constant(spark, 6, 8, 2.0)
    s = tensor.shape(rows)
    assert (s.rows, s.dim, s.elements, s.bytes, s.strides, s.size(-1), s.is_contiguous()) == (6, 8, 48, 192, (8, 1), 8, True)
    assert sorted(r["id"] for r in tensor.narrow_rows(rows, 2, 3).collect()) == [0, 1, 2]
    assert tensor.shape(tensor.narrow_columns(rows, 1, 3)).dim == 3
    assert value(spark, tensor.packed(lit([1, 2, 3, 4]), 2)) == [[1.0, 2.0], [3.0, 4.0]] and value(spark, tensor.packed(lit([1, 2, 3]), 2)) is None
    assert tensor.same_sizes(rows, rows).first()["same_sizes"] and not tensor.same_sizes(rows, rows.where("id < 2")).first()["same_sizes"]
    for bad in (lambda: tensor.narrow_rows(rows, -1, 2), lambda: tensor.narrow_columns(rows, 0, -2), lambda: tensor.reshape(rows, 8, 0)):
        with pytest.raises(ValueError):
            bad()
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id bigint, vector array<double>")
    with pytest.raises(ValueError):
        tensor.shape(ragged)
    assert tensor.shape(rows.where("id < 0")).rows == 0


def test_reductions(spark):
    df = spark.createDataFrame([(0, 5, 1), (0, 2, 9), (0, 2, 3), (1, None, 4)], "g int, k int, v int")
    assert {r["g"]: (r["total"], r["least"], r["greatest"]) for r in reduce.reduced(df, "g", "k").collect()} == {0: (9, 2, 5), 1: (0, None, None)}
    r = {r["g"]: r for r in reduce.extreme_pairs(df.where("k is not null"), "g", "k", "v").collect()}[0]
    assert (r["min_k"], r["min_v"], r["max_k"], r["max_v"]) == (2, 3, 5, 1)


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    plan = tensor.narrow_rows(rows, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "label" not in plan.split("ReadSchema")[1]
