"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and then three times; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from vectide.operators.knn import knn
    from vectide.plans.queries import QUERIES, base_of
    from vectide.runtime import run

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def search(n: int, strategy: str):
        def f(s, d):
            b = base_of(s, d)
            return knn(b, b.where(F.col("id") < n).select(F.col("id").alias("query_id"), "vector"), 10, strategy=strategy)

        return f

    queries = {"knn_200_arrow": search(200, "arrow"), "knn_200_sql": search(200, "sql"), "knn_2000_arrow": search(2000, "arrow")}
    queries |= {k: QUERIES[k] for k in ("knn_l2_exact", "knn_k1_argmin", "knn_two_level", "l2_norm_squared", "row_topk_min", "gemm_nnn", "row_products", "recall_at_k", "set_intersection", "warp_shuffle")}
    times = {}
    for name, f in queries.items():
        run(f(spark, sf))
        each = []
        for _ in range(3):
            began = time.perf_counter()
            run(f(spark, sf))
            each.append(time.perf_counter() - began)
        times[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
