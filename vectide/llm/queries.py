"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.llm._spark import prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), q=8, rate=0.1, window=64)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.ppm import held_out_scores

    return held_out_scores(_table(spark, sf_dir, "documents"), folds=5, held_out=1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.rule_ensemble import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, folds=4, held_out=2, sample=20_000)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.language_id import language_ids

    return language_ids(_table(spark, sf_dir, "documents"), folds=4, held_out=2).select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.license_scan import license_matches

    return license_matches(_table(spark, sf_dir, "documents"), percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vectide.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.suffix_dedup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"), length=50)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5, sample=4000)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vectide.llm.sentencepiece_codec import encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


#: Words of a text, lower-cased, and its distinct n-grams.
SQL_SETS = """
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE {den} * c >= {num} * (na + nb - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM s UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.v)"""

#: Spans that passages of 50 words cover which stand at two places at least.
SQL_REPEATS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS g FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM h),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word, CAST(max(i) + 50 - min(i) AS BIGINT) AS n_words FROM g GROUP BY doc_id, span"""


def oracle_sql() -> dict[str, str]:
    from vectide.llm import license_scan

    return {
        "op6_license_scan": license_scan.sql(percent=80),
        "op8_suffix_dedup": SQL_REPEATS,
        "op4_ngram_join": f"WITH RECURSIVE {SQL_SETS.format(n=3, num=90, den=100)} SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT v, min(root) AS component_id FROM r GROUP BY v) m ON m.v = s.doc_id",
    }
