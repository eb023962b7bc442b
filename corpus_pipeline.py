"""From raw documents to token ids: five stages, each an operator of vectide.llm.

Every stage gets the rows that its predecessor kept, decides on all of them and
hands on documents with the columns of the table ``documents``; the last one
returns token ids. run() writes each stage as Parquet in the folder that all
executors share and reads it again, so a lost executor never costs more than the
stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.llm._spark import Scratch, prepared, released
from vectide.llm.decontamination import without_leaks
from vectide.llm.language_id import of_known_language
from vectide.llm.ngram_join import one_of_each
from vectide.llm.sentencepiece_codec import encoding_digests
from vectide.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or for half of their letters no language that the corpus teaches."""
    prepared(spark)
    return of_known_language(docs, min_share=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 of their five-word shingles."""
    prepared(spark)
    return one_of_each(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one place only."""
    prepared(spark)
    return without_repeats(docs, length=50)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    prepared(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, checked by decoding them."""
    prepared(spark)
    import public_tokenizers

    return encoding_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can't express the models and the alignment; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
        released(spark)
    return docs
