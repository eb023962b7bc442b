"""The corpus pipeline against a brute-force version on a small table."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_pairs import WORD, components, leaks

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    documents = [r for r in rows(seed=11) if r[0] is not None]
    leaked = next(x for i, x, lang, *_ in documents if lang == "en" and i > 20 and len(x) > 300)[50:200].strip()
    documents.append((3000, "Some words of ours and then " + leaked.upper() + " and the rest of this", "en", "s0", 100))
    bench = [(1, leaked), (2, "an item that stands in none of the documents, whatever they hold"), (3, None)]
    spark.createDataFrame(documents, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), documents, bench


def test_stages(spark, folder):
    path, documents, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert docs.columns == columns
        kept.append(docs.cache())
        kept[-1].count()
    langs, near, cut, clean, coded = ([tuple(r) for r in x.collect()] for x in kept)
    # 5: what has letters and one language for half of them stays
    assert Counter(r[0] for r in langs) == Counter(i for i, x, *_ in documents if any(c.isalpha() for c in x or ""))
    # 4: one of each component
    want = {c for _, n, c in components(langs, 5, 80, 100)}
    assert Counter(r[0] for r in near) == Counter(want)
    # 8: no passage of 50 words twice, and what is unique is there
    seen = Counter()
    for r in cut:
        w = WORD.findall(r[1])
        seen.update({tuple(w[k : k + 50]) for k in range(len(w) - 49)})
    assert len(cut) == len(near) and max(seen.values()) == 1
    before = {r[0]: r[1] for r in near}
    passages = Counter(p for x in before.values() for p in zip(*(WORD.findall(x)[k:] for k in range(50))))
    for r in cut:
        w = WORD.findall(before[r[0]])
        if all(passages[tuple(w[k : k + 50])] == 1 for k in range(len(w) - 49)):
            assert r[1] == before[r[0]]
    # 1: no leak stays, nothing else goes
    dirty = {i for i, _ in leaks([(r[0], r[1]) for r in cut], bench, 0.1, 64)}
    assert 3000 in dirty and Counter(r[0] for r in clean) == Counter(r[0] for r in cut if r[0] not in dirty)
    # 10: the library's ids
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = {r[0]: np.frombuffer(r[4], np.int32).tolist() for r in coded}
    assert ids == {r[0]: library.encode(r[1]) for r in clean} and all(r[3] for r in coded)


def test_run_is_the_stages(spark, folder):
    path, *_ = folder
    out = pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    assert pipeline.ORACLE_SQL is None and len(pipeline.STAGES) == 5


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
