"""Quality classifier: a sparse rule ensemble over text statistics (operator 3).

1. Statistics of whole texts are computed in Arrow batches (see STATISTICS).
2. Boosted trees of small depth are grown on a bounded sample of labelled rows;
   every path from a root to a node is a rule, a conjunction of conditions
   ``statistic <= cut`` or ``statistic > cut``.
3. A lasso-penalised logistic regression over the rules' truth values keeps few;
   all of those with a weight stay.
4. The rules that stay are compiled into one Spark column expression, which
   scores all rows inside whole-stage code.

The fit takes at most ``sample`` labelled rows, those with the smallest hash of
their id; statistics and scores cover all rows and whole texts. The compiled
expression has a term for each rule with a weight, some 14 a tree at most.

Edge cases: a null text counts as empty and gets a score like any other; rows
with null ids are scored; null labels, labels without a document and labels that
contradict one another for an id are not learned from; without labels of both kinds the score is the share of label 1
(0.5 without any). An empty table gives no rows; repeated rows are kept; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import batch, crc_mod, lean
from vectide.llm.quality_rules import SYMBOL, agreed, repeats, sigmoid

#: What a rule can ask about, in the order of statistics().
STATISTICS = ["log_words", "word_bytes", "long_words", "symbols", "upper", "digits", "marks", "shouts", "non_ascii", "distinct_words", "repeated_grams", "repeated_lines", "words_per_line", "ended_lines", "title_words"]

CLASS = {
    "upper": np.zeros(256, bool),
    "digit": np.zeros(256, bool),
    "mark": np.zeros(256, bool),
    "letter": np.zeros(256, bool),
}
CLASS["upper"][65:91] = CLASS["digit"][48:58] = True
CLASS["mark"][list(b".,;:!?'\"()[]{}-_/\\@^~`+=")] = True
CLASS["letter"][65:91] = CLASS["letter"][97:123] = CLASS["letter"][128:] = True


def statistics(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a slice."""
    docs = len(offsets) - 1
    starts, ends, first = t.words(b, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(docs), n_words)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    per_doc = lambda flags: np.bincount(doc[flags], minlength=docs)
    per = lambda x, n: x / np.maximum(1, n)
    size = ends - starts
    word_bytes = np.bincount(doc, weights=size, minlength=docs)
    h = t.word_hashes(b, starts, ends)
    _, later = repeats(h, doc)
    i = np.flatnonzero(doc[: max(0, len(h) - 2)] == doc[2:])
    some, _ = repeats(t.rolled(h, i, i + 3, t.WORDS), doc[i])
    breaks = np.flatnonzero(b == 10)
    line_start, line_doc = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([np.arange(docs), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = offsets[line_doc + 1].copy()
    inner = np.flatnonzero(line_doc[1:] == line_doc[:-1])
    line_end[inner] = line_start[inner + 1] - 1
    full = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=docs)
    _, again = repeats(t.word_hashes(b, line_start, line_end), line_doc)
    letters = count(CLASS["letter"][b])
    columns = [
        np.log1p(n_words),
        per(word_bytes, n_words),
        per(per_doc(size > 12), n_words),
        per(count(SYMBOL[b]), word_bytes),
        per(count(CLASS["upper"][b]), letters),
        per(count(CLASS["digit"][b]), word_bytes),
        per(count(CLASS["mark"][b]), word_bytes),
        per(count(b == 33), n_words),
        per(count(b >= 128), word_bytes),
        1 - per(per_doc(later), n_words),
        per(np.bincount(doc[i[some]], minlength=docs), n_words),
        per(np.bincount(line_doc[again], minlength=docs), lines),
        per(n_words, lines),
        per(np.bincount(line_doc[np.isin(b[line_end - 1], list(b".!?"))], minlength=docs), lines),
        per(per_doc(CLASS["upper"][b[starts]]), n_words),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a column for each of STATISTICS instead of the text."""
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.float64()) for x in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            parts = [statistics(b, offsets) for _, _, b, offsets in t.slices(rb.column(1))]
            if parts:
                yield batch(schema, rb.column(0), *np.ascontiguousarray(np.concatenate(parts).T))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, greater, cut


def grow(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, g: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple[Condition, ...]) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """(paths of all nodes below the root, step for each row) of one regression tree on gradients."""
    step = np.zeros(len(g))
    step[rows] = -g[rows].sum() / (hess[rows].sum() + 1.0)
    best = (1e-6, -1, 0)
    if depth:
        for f, cuts in enumerate(bins):
            if not len(cuts):
                continue
            c = codes[rows, f]
            n = np.cumsum(np.bincount(c, minlength=len(cuts) + 1))[:-1]
            gs, hs = np.cumsum(np.bincount(c, g[rows], len(cuts) + 1))[:-1], np.cumsum(np.bincount(c, hess[rows], len(cuts) + 1))[:-1]
            gt, ht = g[rows].sum(), hess[rows].sum()
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    _, f, k = best
    paths = [path] if path else []
    if f < 0:
        return paths, step
    left = codes[rows, f] <= k
    for side, greater in ((rows[left], False), (rows[~left], True)):
        more, s = grow(x, bins, codes, g, hess, side, depth - 1, least, (*path, (f, greater, float(bins[f][k]))))
        paths += more
        step[side] = s[side]
    return paths, step


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[tuple[Condition, ...]]:
    """The distinct rules of boosted trees."""
    bins = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))
        bins.append((v[1:] + v[:-1]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(bins)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        p = sigmoid(margin)
        paths, step = grow(x, bins, codes, p - y, p * (1 - p), np.arange(len(y)), depth, max(2, len(y) // 500), ())
        margin += rate * step
        rules |= dict.fromkeys(paths)
    return list(rules)


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return reduce(and_, ((x[:, f] > cut) if greater else (x[:, f] <= cut) for f, greater, cut in rule))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an l1-penalised logistic regression, by accelerated proximal gradients."""
    n, m = r.shape
    w, bias, z, zb, k = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    rate = 4 / max(1e-9, np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / n)
    for _ in range(steps):
        e = (sigmoid(r @ z + zb) - y) / n
        new = z - rate * (r.T @ e)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        nb = zb - rate * e.sum()
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, zb = new + (k - 1) / k2 * (new - w), nb + (k - 1) / k2 * (nb - bias)
        w, bias, k = new, nb, k2
    return w, bias


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[list[tuple[tuple[Condition, ...], float]], float]:
    """([(rule, weight)], bias)."""
    y = y.astype(np.float64)
    if not len(y) or len(set(y.tolist())) < 2:
        share = np.clip(y.mean(), 0.001, 0.999) if len(y) else 0.5
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float64)
    w, _ = lasso_logistic(r, y, penalty)
    kept = np.flatnonzero(w).tolist()
    if not kept:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    w, bias = lasso_logistic(r[:, kept], y, penalty)
    return [(rules[i], float(v)) for i, v in zip(kept, w, strict=True) if v], float(bias)


def compiled(model: tuple[list[tuple[tuple[Condition, ...], float]], float]) -> Column:
    """The probability of label 1 as one expression over the columns STATISTICS."""
    rules, bias = model
    total = F.lit(bias)
    for rule, weight in rules:
        test = reduce(and_, ((F.col(STATISTICS[f]) > F.lit(cut)) if greater else (F.col(STATISTICS[f]) <= F.lit(cut)) for f, greater, cut in rule))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text); rows of the held-out fold are never learned from."""
    fold = F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False))
    picked = agreed(labels, "quality").where(~fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")  # sample rows at most
    rows = with_statistics(known).join(F.broadcast(picked), "doc_id").orderBy("doc_id", *STATISTICS).limit(sample).toPandas()
    model = fit(rows[STATISTICS].to_numpy(np.float64), rows["label"].to_numpy(np.int64))
    scored = with_statistics(texts).withColumn("score", compiled(model))
    return scored.select("doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
