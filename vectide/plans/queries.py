"""One query per operator over the table ``embeddings``, with the SQL that gives the same rows.

Numbers with a fraction are rounded to six places; adding 0.0 turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import integers as K
from vectide.functions import strings as S
from vectide.functions import vectors as V
from vectide.operators import evaluate, linalg, reduce, tensor, topk
from vectide.operators.knn import knn, knn_tiled, nearest
from vectide.runtime import numbered, scratch_path
from vectide.sources import xvecs
from vectide.sources.datasets import from_frames, load, load_gist, load_sift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def base_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def queries_of(base: DataFrame) -> DataFrame:
    """The vectors whose id is divisible by 20: the stated query set of the searches, against all vectors."""
    return base.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")


def r6(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# --- search -----------------------------------------------------------------

L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
NORM2 = "list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))"
REL = f"{NORM2.format(a='b.embedding')} - 2.0 * {DOT.format(a='q.embedding', b='b.embedding')}"


def knn_sql(distance: str, k: int = 10, base: str = "embeddings", shown: str = "d") -> str:
    return f"""WITH p AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, {distance} AS d, {NORM2.format(a="q.embedding")} AS own FROM {base} b, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbor_id, round({shown}, 6) + 0.0 AS distance FROM r WHERE rank <= {k}"""


EXACT = knn_sql(L2.format(a="q.embedding", b="b.embedding"))
RELATIVE = knn_sql(REL)
EXPANDED = knn_sql(REL, shown="greatest(0.0, d + own)")


@query("knn_l2_exact", EXACT)
def _(s: SparkSession, d: str) -> DataFrame:
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10), "distance")


@query("knn_l2_relative", RELATIVE)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10, exact=False), "distance")


@query("knn_sql_direct", EXACT)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10, strategy="sql"), "distance")


@query("knn_sql_relative", RELATIVE)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10, exact=False, strategy="sql"), "distance")


@query("knn_expanded", EXPANDED)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10, strategy="sql", form="expanded"), "distance")


@query("knn_query_blocks", EXACT)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, queries_of(b), 10, query_bytes=8192), "distance")


@query("knn_all_pairs", knn_sql(L2.format(a="q.embedding", b="b.embedding")).replace("WHERE q.vec_id % 20 = 0", ""))
def _(s, d):
    b = base_of(s, d)
    return rounded(knn(b, b.select(F.col("id").alias("query_id"), "vector"), 10), "distance")


@query("knn_k1_argmin", f"SELECT q.vec_id AS query_id, arg_min(b.vec_id, ({L2.format(a='q.embedding', b='b.embedding')}, b.vec_id)) AS neighbor_id, round(min({L2.format(a='q.embedding', b='b.embedding')}), 6) + 0.0 AS distance FROM embeddings b, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id")
def _(s, d):
    b = base_of(s, d)
    return rounded(nearest(b, queries_of(b)), "distance")


PADDED = """WITH f AS ({knn}), g AS (SELECT q.vec_id AS query_id, unnest(range(1, {k} + 1)) AS rank FROM embeddings q WHERE q.vec_id % 20 = 0)
SELECT g.query_id, CAST(g.rank AS BIGINT) AS rank, coalesce(f.neighbor_id, -1) AS neighbor_id, coalesce(f.distance, 3.4028234663852886e38::DOUBLE) AS distance FROM g LEFT JOIN f ON f.query_id = g.query_id AND f.rank = g.rank"""
#: Cells of all vectors, and the mean vector of each label.
ALL_CELLS = "SELECT vec_id AS i, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"
CENTRES = f"SELECT e.label AS i, c.j, avg(c.v) AS v FROM ({ALL_CELLS}) c JOIN embeddings e ON e.vec_id = c.i GROUP BY e.label, c.j"


def _padded(base: str, k: int) -> str:
    return PADDED.format(knn=knn_sql(L2.format(a="q.embedding", b="b.embedding"), k=k, base=base), k=k)


def centres(b: DataFrame) -> DataFrame:
    """(i, j, v): the mean vector of each label, row i being label i."""
    cells = b.select(F.col("label").cast("bigint").alias("i"), F.posexplode("vector").alias("j", "v"))
    return cells.groupBy("i", F.col("j").cast("bigint").alias("j")).agg(F.avg(F.col("v").cast("double")).alias("v"))


# a base of the label centres, so that there are fewer vectors than ranks
@query("knn_padded", _padded(f"(SELECT i AS vec_id, list(v ORDER BY j) AS embedding FROM ({CENTRES}) GROUP BY i)", 16))
def _(s, d):
    b = base_of(s, d)
    found = knn(linalg.rows_of(centres(b)), queries_of(b), 16, pad=True)
    return found.withColumn("distance", F.when(F.col("neighbor_id") < 0, F.col("distance")).otherwise(r6(F.col("distance"))))


@query("knn_empty_base", _padded("(SELECT * FROM embeddings WHERE vec_id < 0)", 10))
def _(s, d):
    b = base_of(s, d)
    return knn(b.where("id < 0"), queries_of(b), 10, pad=True)


@query("knn_two_level", EXACT)
def _(s, d):
    b = base_of(s, d)
    return rounded(knn_tiled(b, queries_of(b), 10, tile=128), "distance")


@query("knn_wide", f"SELECT query_id, array_to_string(list(neighbor_id ORDER BY rank), ',') AS neighbors FROM ({EXACT}) GROUP BY query_id")
def _(s, d):
    b = base_of(s, d)
    return topk.wide(knn(b, queries_of(b), 10)).select("query_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("knn_long", EXACT)
def _(s, d):
    b = base_of(s, d)
    return rounded(topk.long(topk.wide(knn(b, queries_of(b), 10))), "distance")


@query("index_search", knn_sql(L2.format(a="q.embedding", b="b.embedding"), k=5))
def _(s, d):
    from vectide.operators.index import IndexConfig, VectorIndex

    b = base_of(s, d)
    index = VectorIndex(s, 64, IndexConfig(storage="none"))
    half = b.count() // 2
    # ids of a second batch go on from the first
    index.add(b.where(F.col("id") < half)).add(b.where(F.col("id") >= half).withColumn("id", F.col("id") - half))
    return rounded(index.search(queries_of(b), 5), "distance")


# --- norms, products, views --------------------------------------------------


@query("l2_norm_squared", f"SELECT vec_id AS id, round({NORM2.format(a='embedding')}, 6) AS norm FROM embeddings")
def _(s, d):
    return rounded(linalg.norms(base_of(s, d)), "norm")


@query("l2_norm", f"SELECT vec_id AS id, round(sqrt({NORM2.format(a='embedding')}), 6) AS norm FROM embeddings")
def _(s, d):
    return rounded(linalg.norms(base_of(s, d), squared=False), "norm")


@query("l2_norm_cells", "WITH c AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT i, round(sqrt(sum(v * v)), 6) AS norm FROM c GROUP BY i")
def _(s, d):
    return rounded(linalg.norms_of_cells(linalg.coordinates(base_of(s, d)), squared=False), "norm")


def _row_topk_sql(order: str, label: str, k: int = 5) -> str:
    return f"""WITH c AS (SELECT vec_id AS id, {label} AS label, embedding[p + 1]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS p FROM embeddings)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value {order}, label) AS rank FROM c)
SELECT id, CAST(rank AS BIGINT) AS rank, label, round(value, 6) + 0.0 AS value FROM r WHERE rank <= {k}"""


@query("row_topk_min", _row_topk_sql("ASC", "p"))
def _(s, d):
    return rounded(topk.select_rows(base_of(s, d), "id", "vector", 5), "value")


@query("row_topk_max", _row_topk_sql("DESC", "p"))
def _(s, d):
    return rounded(topk.select_rows(base_of(s, d), "id", "vector", 5, largest=True), "value")


@query("row_topk_labeled", _row_topk_sql("ASC", "1000 + p"))
def _(s, d):
    b = base_of(s, d).withColumn("labels", F.transform("vector", lambda x, i: i + 1000))
    return rounded(topk.select_rows(b, "id", "vector", 5, labels="labels"), "value")


@query("row_topk_window", _row_topk_sql("ASC", "p", 3))
def _(s, d):
    cells = linalg.coordinates(base_of(s, d)).select(F.col("i").alias("id"), F.col("j").alias("label"), F.col("v").alias("value"))
    return rounded(topk.ranked(cells, "id", "value", "label", 3), "value").select("id", "rank", "label", "value")


@query("row_topk_padded", "WITH c AS (SELECT vec_id AS id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS v FROM embeddings), g AS (SELECT id, list_sort(v) AS v, unnest(range(1, 5)) AS rank FROM c) SELECT id, CAST(rank AS BIGINT) AS rank, CASE WHEN rank <= 2 THEN 0 ELSE -1 END::BIGINT AS found, CASE WHEN rank <= 2 THEN round(v[rank], 6) + 0.0 ELSE 3.4028234663852886e38::DOUBLE END AS value FROM g")
def _(s, d):
    b = tensor.narrow_columns(base_of(s, d), 0, 2)
    out = topk.select_rows(b, "id", "vector", 4, pad=True)
    return out.select("id", "rank", F.when(F.col("label") < 0, -1).otherwise(0).cast("bigint").alias("found"), F.when(F.col("label") < 0, F.col("value")).otherwise(r6(F.col("value"))).alias("value"))


@query("broadcast_row_sum", f"WITH c AS (SELECT vec_id AS i, unnest(range(0, len(embedding))) AS j, embedding, {NORM2.format(a='embedding')} AS n FROM embeddings) SELECT i, j, round(embedding[j + 1]::DOUBLE + n, 6) + 0.0 AS v FROM c")
def _(s, d):
    b = base_of(s, d)
    n = linalg.norms(b).select(F.col("id").alias("i"), F.col("norm").alias("value"))
    return rounded(linalg.add_per_row(linalg.coordinates(b), n), "v")


@query("broadcast_row_sum_rows", f"SELECT vec_id AS id, round(embedding[1]::DOUBLE + {NORM2.format(a='embedding')}, 6) + 0.0 AS first FROM embeddings")
def _(s, d):
    b = base_of(s, d).withColumn("n", V.squared_norm("vector"))
    return linalg.add_to_rows(b, "n").select("id", r6(F.col("vector")[0]).alias("first"))


# A: all vectors, B: the label centres, C: 1 where a vector has a label; A times B transposed is a row per vector and a column per label
ONE_HOT = "SELECT e.vec_id AS i, l.label AS j, CASE WHEN e.label = l.label THEN 1.0 ELSE 0.0 END AS v FROM embeddings e, (SELECT DISTINCT label FROM embeddings) l"


def _one_hot(b: DataFrame) -> DataFrame:
    labels = b.agg(F.array_sort(F.collect_set("label")).alias("all"))  # one row, of as many elements as there are labels
    return b.join(F.broadcast(labels)).select(F.col("id").alias("i"), "label", F.explode("all").alias("j")).select("i", F.col("j").cast("bigint").alias("j"), F.when(F.col("j") == F.col("label"), 1.0).otherwise(0.0).alias("v"))


def _gemm_sql(ta: bool, tb: bool, tc: bool, alpha: float, beta: float) -> str:
    """SQL on inputs that lie transposed where the flag says so, with the result transposed where tc does."""
    lying = lambda x, t: f"(SELECT {'j AS i, i AS j' if t else 'i, j'}, v FROM {x})"
    i, j = ("j", "i") if tc else ("i", "j")
    return f"""WITH x AS ({ALL_CELLS}), y AS ({CENTRES}), z AS ({ONE_HOT}), a AS {lying("x", ta)}, b AS {lying("y", not tb)}, c AS {lying("z", tc)},
m AS (SELECT a.i, b.j, {alpha} * a.v * b.v AS v FROM {lying("a", ta)} a JOIN {lying("b", tb)} b ON a.j = b.i UNION ALL SELECT i, j, {beta} * v FROM {lying("c", tc)})
SELECT {i} AS i, {j} AS j, round(sum(v), 6) + 0.0 AS v FROM m GROUP BY m.i, m.j"""


def _gemm(ta: bool, tb: bool, tc: bool, alpha: float, beta: float) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        b = base_of(s, d)
        x, y, z = linalg.coordinates(b), centres(b), _one_hot(b)
        return rounded(linalg.gemm(linalg.transpose(x) if ta else x, y if tb else linalg.transpose(y), linalg.transpose(z) if tc else z, ta, tb, tc, alpha, beta), "v")

    return run


for _ta in (False, True):
    for _tb in (False, True):
        for _tc in (False, True):
            _name = f"gemm_{'t' if _ta else 'n'}{'t' if _tb else 'n'}{'t' if _tc else 'n'}"
            query(_name, _gemm_sql(_ta, _tb, _tc, 1.0, 0.0))(_gemm(_ta, _tb, _tc, 1.0, 0.0))
query("gemm_alpha_beta", _gemm_sql(False, True, False, -2.0, 1.0))(_gemm(False, True, False, -2.0, 1.0))


@query("row_products", f"SELECT a.vec_id AS i, q.vec_id AS j, round(-2.0 * {DOT.format(a='a.embedding', b='q.embedding')}, 6) + 0.0 AS v FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0")
def _(s, d):
    b = base_of(s, d)
    return rounded(linalg.row_products(b, queries_of(b).withColumnRenamed("query_id", "id"), alpha=-2.0), "v")


@query("matrix_transpose", f"SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM ({ALL_CELLS})")
def _(s, d):
    return rounded(linalg.transpose(linalg.coordinates(base_of(s, d))), "v")


@query("narrow_rows", "SELECT vec_id - 100 AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings WHERE vec_id >= 100 AND vec_id < 120")
def _(s, d):
    return tensor.narrow_rows(base_of(s, d), 100, 20).select("id", r6(F.col("vector")[0].cast("double")).alias("first"))


@query("narrow_cols", "SELECT vec_id AS id, len(embedding[11:15])::BIGINT AS dim, round(embedding[11]::DOUBLE, 6) + 0.0 AS first, round(embedding[15]::DOUBLE, 6) + 0.0 AS last FROM embeddings")
def _(s, d):
    v = F.col("vector")
    return tensor.narrow_columns(base_of(s, d), 10, 5).select("id", F.size(v).cast("bigint").alias("dim"), r6(v[0].cast("double")).alias("first"), r6(v[4].cast("double")).alias("last"))


def _reshape_sql(dim: int) -> str:
    return f"WITH c AS (SELECT vec_id * 64 + j AS flat, embedding[j + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS j FROM embeddings)) SELECT flat // {dim} AS i, flat % {dim} AS j, round(v, 6) + 0.0 AS v FROM c"


@query("reshape_view", _reshape_sql(16))
def _(s, d):
    return rounded(linalg.coordinates(tensor.reshape(base_of(s, d).select("id", "vector"), 64, 16)), "v")


@query("reshape_view_wider", _reshape_sql(96))
def _(s, d):
    return rounded(linalg.coordinates(tensor.reshape(base_of(s, d).select("id", "vector"), 64, 96)), "v")


@query("cast_pack4", "SELECT vec_id AS id, CAST(len(embedding) // 4 AS BIGINT) AS packs, round(embedding[4 * 3 + 1]::DOUBLE, 6) + 0.0 AS v30, round(embedding[64]::DOUBLE, 6) + 0.0 AS last, CAST(len(embedding) AS BIGINT) AS flat FROM embeddings")
def _(s, d):
    p = base_of(s, d).withColumn("p", tensor.packed("vector", 4))
    return p.select("id", F.size("p").cast("bigint").alias("packs"), r6(F.col("p")[3][0].cast("double")).alias("v30"), r6(F.col("p")[15][3].cast("double")).alias("last"), F.size(tensor.unpacked("p")).cast("bigint").alias("flat"))


@query("element_access", "SELECT round(embedding[8]::DOUBLE, 6) + 0.0 AS value FROM embeddings WHERE vec_id = 3")
def _(s, d):
    return tensor.element(base_of(s, d), 3, 7).select(r6(F.col("value").cast("double")).alias("value"))


@query("element_assignment", f"SELECT vec_id AS id, round({NORM2.format(a='embedding')} - embedding[3]::DOUBLE * embedding[3]::DOUBLE + 25.0, 6) AS norm FROM embeddings")
def _(s, d):
    b = base_of(s, d).withColumn("vector", tensor.with_element("vector", 2, F.lit(5.0).cast("float")))
    return rounded(linalg.norms(b), "norm")


@query("shape_info", "SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(count(*) * max(len(embedding)) AS BIGINT) AS n_elements, CAST(count(*) * max(len(embedding)) * 4 AS BIGINT) AS n_bytes, false AS ragged FROM embeddings")
def _(s, d):
    return tensor.shape_table(base_of(s, d))


@query("same_sizes", "SELECT true AS same_rank, count(*) = count(embedding) AND min(len(embedding)) = max(len(embedding)) AS same_sizes, CASE WHEN max(len(embedding)) = 32 THEN true ELSE false END AS same_as_half FROM embeddings")
def _(s, d):
    b = base_of(s, d)
    half = tensor.same_sizes(b, tensor.narrow_columns(b, 0, 32)).select(F.col("same_sizes").alias("same_as_half"))
    return tensor.same_sizes(b, b.withColumn("vector", V.negate("vector"))).join(half, F.lit(True))  # one row each


# --- evaluation --------------------------------------------------------------

@query("set_intersection", "SELECT label AS value FROM embeddings INTERSECT ALL SELECT CAST(vec_id % 7 AS INTEGER) AS value FROM embeddings")
def _(s, d):
    b = base_of(s, d)
    return evaluate.intersect_all(b.select(F.col("label").alias("value")), b.select((F.col("id") % 7).cast("int").alias("value")))


HITS = f"""WITH t AS ({EXACT}), f AS ({EXACT.replace('q.embedding, b.embedding', 'q.embedding[1:32], b.embedding[1:32]')}),
h AS (SELECT t.query_id, count(f.neighbor_id) AS hits FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.neighbor_id = t.neighbor_id GROUP BY t.query_id)"""


def _half(s, d):
    b = base_of(s, d)
    short = tensor.narrow_columns(b, 0, 32)
    lists = lambda x: topk.wide(knn(x, queries_of(x), 10)).select("query_id", "neighbors")
    return from_frames("half", b, queries_of(b), lists(b)), lists(short)


@query("recall_at_k", f"{HITS} SELECT round(avg(hits / 10.0), 6) AS recall FROM h")
def _(s, d):
    data, found = _half(s, d)
    return rounded(data.recall(found), "recall")


@query("recall_diff", f"{HITS} SELECT query_id, 10 - hits AS diff FROM h")
def _(s, d):
    data, found = _half(s, d)
    return data.recall_diff(found)


@query("recall_membership", f"WITH t AS ({EXACT}), f AS ({EXACT.replace('q.embedding, b.embedding', 'q.embedding[1:32], b.embedding[1:32]')}) SELECT f.query_id, f.neighbor_id FROM f SEMI JOIN t ON f.query_id = t.query_id AND f.neighbor_id = t.neighbor_id")
def _(s, d):
    b = base_of(s, d)
    short = tensor.narrow_columns(b, 0, 32)
    return evaluate.membership(knn(short, queries_of(short), 10).select("query_id", "neighbor_id"), knn(b, queries_of(b), 10))


@query("dataset_info", "SELECT CAST(max(len(embedding)) AS BIGINT) AS dim, count(*) AS n_base, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_queries, CAST(10 AS BIGINT) AS truth_k FROM embeddings")
def _(s, d):
    return _half(s, d)[0].info()


# --- element-wise arithmetic ---------------------------------------------------

# a: elements 1 to 4, b: elements 5 to 8 of every vector
E = [f"embedding[{i}]::DOUBLE" for i in range(1, 9)]


def elementwise(name: str, make: Callable[[Column, Column], Column], sql: list[str]) -> None:
    """A query (id, c0, c1, ...) of a vector made of a and b."""

    def run(s: SparkSession, d: str) -> DataFrame:
        b = base_of(s, d).select("id", F.slice("vector", 1, len(sql)).alias("a"), F.slice("vector", 5, len(sql)).alias("b"))
        v = b.select("id", make(F.col("a"), F.col("b")).alias("v"))
        return v.select("id", *(r6(F.col("v")[i].cast("double")).alias(f"c{i}") for i in range(len(sql))))

    columns = ", ".join(f"round(({x})::DOUBLE, 6) + 0.0 AS c{i}" for i, x in enumerate(sql))
    query(name, f"SELECT vec_id AS id, {columns} FROM embeddings")(run)


def four(pattern: str) -> list[str]:
    return [pattern.format(x=E[i], y=E[i + 4]) for i in range(4)]


elementwise("vec_construct_splat", lambda a, b: V.splat(a[0], 4), [E[0]] * 4)
elementwise("vec_construct_truncate", lambda a, b: V.widened(V.truncated(a, 2)), [E[0], E[1], "0.0"])
elementwise("vec_construct_widen", lambda a, b: V.widened(V.widened(V.truncated(a, 2)), 7.0), [E[0], E[1], "0.0", "7.0"])
elementwise("vec_to_int", lambda a, b: V.to_int(V.multiply(a, 100.0)), four("trunc({x} * 100.0)"))
elementwise("vec_to_uint", lambda a, b: V.to_uint(V.to_int(V.multiply(a, 100.0))), four("(trunc({x} * 100.0)::BIGINT % 4294967296 + 4294967296) % 4294967296"))
elementwise("vec_neg", lambda a, b: V.negate(a), four("-{x}"))
elementwise("vec_add", lambda a, b: V.add(a, b), four("{x} + {y}"))
elementwise("vec_add_scalar", lambda a, b: V.add(2.5, a), four("2.5::DOUBLE + {x}"))
elementwise("vec_sub", lambda a, b: V.subtract(a, b), four("{x} - {y}"))
elementwise("vec_sub_scalar", lambda a, b: V.subtract(1.0, a), four("1.0::DOUBLE - {x}"))
elementwise("vec_mul", lambda a, b: V.multiply(a, b), four("{x} * {y}"))
elementwise("vec_mul_scalar", lambda a, b: V.multiply(a, 3.0), four("{x} * 3.0::DOUBLE"))
elementwise("vec_div", lambda a, b: V.divide(a, V.add(V.absolute(b), 1.0)), four("{x} / (abs({y}) + 1.0::DOUBLE)"))
elementwise("vec_div_scalar", lambda a, b: V.divide(1.0, V.add(V.absolute(a), 1.0)), four("1.0::DOUBLE / (abs({x}) + 1.0::DOUBLE)"))
elementwise("vec_min", lambda a, b: V.minimum(a, b), four("least({x}, {y})"))
elementwise("vec_max", lambda a, b: V.maximum(a, b), four("greatest({x}, {y})"))
elementwise("vec_lerp", lambda a, b: V.lerp(a, b, 0.25), four("{x} + 0.25::DOUBLE * ({y} - {x})"))
elementwise("vec_clamp", lambda a, b: V.clamp(a, -0.05, 0.05), four("greatest(-0.05::DOUBLE, least({x}, 0.05::DOUBLE))"))
elementwise("vec_floor", lambda a, b: V.floor(V.multiply(a, 10.0)), four("floor({x} * 10.0::DOUBLE)"))
elementwise("vec_frac", lambda a, b: V.frac(V.multiply(a, 10.0)), four("{x} * 10.0::DOUBLE - floor({x} * 10.0::DOUBLE)"))
elementwise("vec_fmod", lambda a, b: V.fmod(V.multiply(a, 10.0), 0.7), four("({x} * 10.0::DOUBLE) % 0.7::DOUBLE"))
elementwise("vec_abs", lambda a, b: V.absolute(a), four("abs({x})"))
elementwise("vec_smoothstep", lambda a, b: V.smoothstep(-0.1, 0.1, a), four("(greatest(0.0::DOUBLE, least(({x} - -0.1::DOUBLE) / (0.1::DOUBLE - -0.1::DOUBLE), 1.0::DOUBLE)) ** 2) * (3.0::DOUBLE - 2.0::DOUBLE * greatest(0.0::DOUBLE, least(({x} - -0.1::DOUBLE) / (0.1::DOUBLE - -0.1::DOUBLE), 1.0::DOUBLE)))"))
elementwise("vec_normalize", lambda a, b: V.normalized(a), [f"{x} / sqrt({' + '.join(f'{y} * {y}' for y in E[:4])})" for x in E[:4]])
_d3 = f"({E[4]} * {E[0]} + {E[5]} * {E[1]} + {E[6]} * {E[2]})"
elementwise("vec_reflect", lambda a, b: V.reflect(a, b), [f"{E[i]} - 2.0::DOUBLE * {E[i + 4]} * {_d3}" for i in range(3)])
elementwise("vec_cross", lambda a, b: V.cross(a, b), [f"{E[i]} * {E[j + 4]} - {E[j]} * {E[i + 4]}" for i, j in ((1, 2), (2, 0), (0, 1))])


def scalar_query(name: str, make: Callable[[Column, Column], Column], sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        b = base_of(s, d).select("id", F.slice("vector", 1, 4).alias("a"), F.slice("vector", 5, 4).alias("b"))
        return b.select("id", r6(make(F.col("a"), F.col("b"))).alias("value"))

    query(name, f"SELECT vec_id AS id, round({sql}, 6) + 0.0 AS value FROM embeddings")(run)


scalar_query("vec_sumc", lambda a, b: V.sumc(a), " + ".join(E[:4]))
scalar_query("vec_dot", lambda a, b: V.dot(a, b), " + ".join(f"{E[i]} * {E[i + 4]}" for i in range(4)))
scalar_query("vec_length", lambda a, b: V.norm(a), f"sqrt({' + '.join(f'{x} * {x}' for x in E[:4])})")
scalar_query("vec_rsqrt", lambda a, b: 1.0 / V.norm(a), f"1.0::DOUBLE / sqrt({' + '.join(f'{x} * {x}' for x in E[:4])})")


# --- integers, bits, strings ---------------------------------------------------

POW = "(1::BIGINT << CASE WHEN vec_id <= 1 THEN 0 ELSE length(bin(vec_id)) - 1 END)"


@query("int_helpers", f"""SELECT vec_id AS id, (vec_id + 6) // 7 AS div_up, (vec_id + 6) // 7 * 7 AS round_up, vec_id // 7 * 7 AS round_down,
CAST(CASE WHEN vec_id <= 1 THEN 0 ELSE length(bin(vec_id)) - 1 END AS BIGINT) AS log2, vec_id > 0 AND bit_count(vec_id) = 1 AS power, {POW} * 2 AS next_power,
CAST(sign(vec_id - 250) * floor(abs(vec_id - 250) / 4.0 + 0.5) AS INTEGER) AS nearest, greatest(vec_id, 100) AS larger FROM embeddings""")
def _(s, d):
    i = F.col("id")
    return base_of(s, d).select("id", K.div_up(i, 7).alias("div_up"), K.round_up(i, 7).alias("round_up"), K.round_down(i, 7).alias("round_down"), K.log2_floor(i).alias("log2"), K.is_power_of_2(i).alias("power"), K.next_power_of_2(i).alias("next_power"), K.round_half_away((i - 250) / 4.0).alias("nearest"), F.greatest(i, F.lit(100).cast("bigint")).alias("larger"))


@query("bit_helpers", """SELECT vec_id AS id, (vec_id >> 2) & 7 AS field, (vec_id & ~(15::BIGINT << 3)) | ((label::BIGINT & 15) << 3) AS with_field, CAST(bit_count(vec_id) AS INTEGER) AS ones,
CASE WHEN vec_id % 2 = 0 THEN label::BIGINT ELSE vec_id END AS chosen FROM embeddings""")
def _(s, d):
    i = F.col("id")
    return base_of(s, d).select("id", K.get_bits(i, 2, 3).alias("field"), K.set_bits(i, "label", 3, 4).alias("with_field"), K.popcount(i).alias("ones"), K.choose(i % 2 == 0, F.col("label").cast("bigint"), i).alias("chosen"))


@query("lane_masks", "WITH l AS (SELECT vec_id AS id, vec_id % 32 AS lane FROM embeddings) SELECT id, lane, (1::BIGINT << lane) - 1 AS lt, (2::BIGINT << lane) - 1 AS le, 4294967295 - ((2::BIGINT << lane) - 1) AS gt, 4294967295 - ((1::BIGINT << lane) - 1) AS ge FROM l")
def _(s, d):
    return base_of(s, d).select("id", K.lane("id").alias("lane"), *(m.alias(n) for n, m in K.lane_masks("id").items()))


@query("pair_order", "SELECT vec_id AS id, label < 5 OR label = 5 AND vec_id < 100 AS less, label = 5 AND vec_id = 100 AS equal FROM embeddings")
def _(s, d):
    p, q = K.pair(F.col("label"), F.col("id")), K.pair(F.lit(5), F.lit(100).cast("bigint"))
    return base_of(s, d).select("id", (p < q).alias("less"), (p == q).alias("equal"))


@query("numeric_limits", "SELECT * FROM (VALUES ('float', 0.0::DOUBLE, 1.0::DOUBLE, -3.4028234663852886e38::DOUBLE, 3.4028234663852886e38::DOUBLE), ('int', 0, 1, -2147483648, 2147483647), ('uint', 0, 1, 0, 4294967295)) t(kind, zero, one, least, greatest)")
def _(s, d):
    return s.createDataFrame([(k, *map(float, v)) for k, v in K.LIMITS.items()], "kind string, zero double, one double, least double, greatest double")


@query("string_helpers", "SELECT n_name AS name, CAST(2 AS INTEGER) AS starts, 'fvecs' AS extension, CAST(NULL AS VARCHAR) AS none FROM nation")
def _(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_name").alias("name"), S.delimiter_end(F.concat(F.lit("--"), "n_name"), "-").alias("starts"), S.file_extension(F.concat(F.lit("a.b/"), "n_name", F.lit(".fvecs"))).alias("extension"), S.file_extension(F.regexp_replace("n_name", "[.]", "")).alias("none"))


# --- reductions, lanes -----------------------------------------------------------


@query("reduce_sum_min_max", "SELECT label, CAST(coalesce(sum(vec_id), 0) AS BIGINT) AS total, min(vec_id) AS least, max(vec_id) AS greatest FROM embeddings GROUP BY label")
def _(s, d):
    return reduce.reduced(base_of(s, d), "label", "id")


@query("pair_min_max", "SELECT label, min(vec_id % 7) AS min_k, arg_min(vec_id, (vec_id % 7, vec_id)) AS min_v, max(vec_id % 7) AS max_k, arg_max(vec_id, (vec_id % 7, vec_id)) AS max_v FROM embeddings GROUP BY label")
def _(s, d):
    return reduce.extreme_pairs(base_of(s, d).withColumn("k", F.col("id") % 7), "label", "k", "id")


@query("generic_reduce", "SELECT vec_id AS id, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS greatest FROM embeddings")
def _(s, d):
    return base_of(s, d).select("id", F.round(reduce.fold("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))), 6).alias("greatest"))


@query("grouped_argmin", "SELECT label, min(vec_id % 11) AS least, arg_min(vec_id, (vec_id % 11, vec_id)) AS id FROM embeddings GROUP BY label")
def _(s, d):
    return topk.best(base_of(s, d).withColumn("least", F.col("id") % 11), "label", "least", "id").select("label", "least", "id")


@query("warp_shuffle", """WITH e AS (SELECT vec_id AS id, label, vec_id // 32 AS w, vec_id % 32 AS l FROM embeddings)
SELECT id, label, coalesce(lag(label, 3) OVER o, label) AS up, coalesce(lead(label, 3) OVER o, label) AS down,
coalesce((SELECT x.label FROM e x WHERE x.w = e.w AND x.l = xor(e.l, 5)), label) AS xor_value, coalesce((SELECT x.label FROM e x WHERE x.w = e.w AND x.l = 2), label) AS from_lane
FROM e WINDOW o AS (PARTITION BY w ORDER BY id)""")
def _(s, d):
    return reduce.shuffled(base_of(s, d).select("id", "label"), "id", "label", delta=3, xor=5, source=2)


@query("warp_vote", "SELECT vec_id // 32 AS warp, bool_and(label < 9) AS all_true, bool_or(label > 8) OR bool_or(label < 9) AS any_true, CAST(bit_or(CASE WHEN label < 9 THEN 1::BIGINT << (vec_id % 32) ELSE 0 END) AS BIGINT) AS ballot, CAST(bit_or(1::BIGINT << (vec_id % 32)) AS BIGINT) AS active FROM embeddings GROUP BY 1")
def _(s, d):
    return reduce.votes(base_of(s, d), "id", F.col("label") < 9)


@query("full_sort", "SELECT vec_id AS id, label, row_number() OVER (ORDER BY label DESC, vec_id DESC) AS place FROM embeddings")
def _(s, d):
    # places from the sorted partitions: each starts where those before it end, so no window takes all rows
    rows = reduce.sorted_values(base_of(s, d).select("id", "label"), "label", "id", descending=True)
    return numbered(rows, "place").withColumn("place", F.col("place") + 1)


# --- sources -----------------------------------------------------------------------


@query("xvecs_scan", "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(embedding[64]::DOUBLE, 6) + 0.0 AS last FROM embeddings")
def _(s, d):
    xvecs.register(s)
    path = scratch_path(s, "xvecs") + ".fvecs"
    # range partitions in order, so the number of a record is its id
    base_of(s, d).select("id", "vector").repartitionByRange(4, "id").sortWithinPartitions("id").write.format("xvecs").mode("overwrite").save(path)
    v = F.col("vector")
    return s.read.format("xvecs").option("splitBytes", 32768).load(path).select("id", F.size(v).cast("bigint").alias("dim"), r6(v[0].cast("double")).alias("first"), r6(v[63].cast("double")).alias("last"))


@query("random_matrix")
def _(s, d):
    return linalg.gaussian(s, 1000, 16, mean=1.0, stddev=2.0, seed=7)


@query("random_matrix_moments", "SELECT CAST(20000 AS BIGINT) AS n, CAST(16 AS BIGINT) AS dim, true AS mean_holds, true AS stddev_holds, true AS symmetric, true AS again_the_same")
def _(s, d):
    # 320,000 numbers: the mean lies within 0.02 of 1 and the deviation within 0.02 of 2 but for one seed in millions
    x = linalg.gaussian(s, 20000, 16, mean=1.0, stddev=2.0, seed=7)
    again = linalg.gaussian(s, 20000, 16, mean=1.0, stddev=2.0, seed=7).agg(F.sum(V.sumc("vector")).alias("total2"))
    cells = linalg.coordinates(x).agg(F.countDistinct("i").alias("n"), (F.max("j") + 1).alias("dim"), F.avg("v").alias("m"), F.stddev("v").alias("s"), F.avg((F.col("v") > 1).cast("double")).alias("above"), F.sum("v").alias("total"))
    v = F.col
    return cells.join(again, F.lit(True)).select("n", "dim", (F.abs(v("m") - 1) < 0.02).alias("mean_holds"), (F.abs(v("s") - 2) < 0.02).alias("stddev_holds"), (F.abs(v("above") - 0.5) < 0.01).alias("symmetric"), (F.abs(v("total") - v("total2")) < 1e-3).alias("again_the_same"))  # one row each


@query("constant_matrix", "SELECT range AS id, 0.0::DOUBLE AS total, CAST(8 AS BIGINT) AS dim FROM range(100)")
def _(s, d):
    return linalg.constant(s, 100, 8).select("id", V.sumc("vector").alias("total"), F.size("vector").cast("bigint").alias("dim"))


@query("search_driver", "SELECT range AS query_id, CAST(r AS BIGINT) AS rank, CAST(n AS BIGINT) AS neighbor_id, CAST(x AS DOUBLE) AS distance FROM range(100), (VALUES (1, 1, -128), (2, 0, 0), (3, 2, 0), (4, 3, 384), (5, 4, 1024), (6, 5, 1920), (7, 6, 3072), (8, 7, 4480), (9, 8, 6144), (10, 9, 8064)) t(r, n, x)")
def _(s, d):
    # base vector i holds min(i, 10) everywhere, queries hold 1
    base = s.range(1000).select("id", V.splat(F.least("id", F.lit(10)).cast("float"), 128).alias("vector"))
    ones = s.range(100).select(F.col("id").alias("query_id"), V.splat(F.lit(1.0).cast("float"), 128).alias("vector"))
    return knn(base, ones, 10, exact=False)


@query("norm_driver", "SELECT range AS id, 512.0::DOUBLE AS norm FROM range(100)")
def _(s, d):
    return linalg.norms(linalg.constant(s, 100, 512, 1.0))



def _written(s: SparkSession, d: str, name: str) -> str:
    """A folder with base, queries and true neighbours of ``embeddings`` as xvecs files, each in order of its ids."""
    xvecs.register(s)
    folder, b = scratch_path(s, "dataset"), base_of(s, d)
    truth = topk.wide(knn(b, queries_of(b), 10)).select(F.col("query_id").alias("id"), F.transform("neighbors", lambda x: x.cast("int")).alias("vector"))
    for rows, file in ((b, "base.fvecs"), (queries_of(b).withColumnRenamed("query_id", "id"), "query.fvecs"), (truth, "groundtruth.ivecs")):
        rows.select("id", "vector").repartitionByRange(4, "id").sortWithinPartitions("id").write.format("xvecs").mode("overwrite").save(f"{folder}/{name}_{file}")
    return folder


@query("dataset_files", "SELECT CAST(max(len(embedding)) AS BIGINT) AS dim, count(*) AS n_base, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_queries, CAST(10 AS BIGINT) AS truth_k, 1.0::DOUBLE AS recall FROM embeddings")
def _(s, d):
    data = load(s, "mine", _written(s, d, "mine"))
    return data.info().join(data.recall(data.found()), F.lit(True))  # one row each


# queries are numbered from 0 in the file: number n is vector 20 * n
TRUTH = f"SELECT query_id // 20 AS query_id, array_to_string(list(neighbor_id ORDER BY rank), ',') AS neighbors FROM ({EXACT}) GROUP BY query_id"


@query("dataset_sift", TRUTH)
def _(s, d):
    return load_sift(s, _written(s, d, "sift")).truth.select("query_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("dataset_gist", TRUTH)
def _(s, d):
    return load_gist(s, _written(s, d, "gist")).found().select("query_id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("index_life", "SELECT true AS trained, CAST(0 AS BIGINT) AS n_before, count(*) AS n_added, CAST(0 AS BIGINT) AS n_after_reset, CAST(0 AS BIGINT) AS found_after_reset, 2 * count(*) AS n_again FROM embeddings")
def _(s, d):
    from vectide.operators.index import IndexConfig, VectorIndex

    b = base_of(s, d)
    index = VectorIndex(s, 64, IndexConfig(storage="none"))
    trained, before = index.train(b).is_trained, index.count
    added = index.add(b.select("vector")).count
    after = index.reset().count
    left = index.search(queries_of(b), 3).count()
    again = index.add(b).add(b).count
    return s.createDataFrame([(trained, before, added, after, left, again)], "trained boolean, n_before bigint, n_added bigint, n_after_reset bigint, found_after_reset bigint, n_again bigint")


@query("index_search_arrays", f"WITH f AS ({knn_sql(L2.format(a='q.embedding', b='b.embedding'), k=3)}) SELECT query_id // 20 AS place, CAST(rank AS BIGINT) AS rank, neighbor_id, distance FROM f")
def _(s, d):
    from vectide.operators.index import IndexConfig, VectorIndex

    b = base_of(s, d)
    ids, distances = VectorIndex(s, 64, IndexConfig(storage="none")).add(b).search_arrays(queries_of(b), 3)  # matrices are what this call gives
    rows = [(q, r + 1, int(ids[q, r]), float(distances[q, r])) for q in range(len(ids)) for r in range(3)]
    return rounded(s.createDataFrame(rows, "place bigint, rank bigint, neighbor_id bigint, distance double"), "distance")
