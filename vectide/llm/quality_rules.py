"""Quality rules: exact base rules and a hashed n-gram model (operator 9).

The base rules count words, symbols, repeated lines and repeated three-word
windows exactly. The model is a logistic regression over hashed word n-grams (1
and 2) and character n-grams (3 and 5 bytes), fitted on labelled rows, calibrated
to probabilities on rows it was not fitted on, and scored in Arrow batches
against a fixed threshold. A text's features are the relative frequencies of its
n-grams, so its score is a mean of weights: one table look-up per n-gram.

The fit takes at most ``sample`` labelled rows (those with the smallest hash of
their id); the weights are two tables of 2**18 floats, whatever the corpus. The
base rules and the scores cover all rows and whole texts.

Edge cases: a null text counts as empty; a text without words fails the base
rules; rows with null ids or without labels are scored like any other; labels
that are null, whose document is missing or that contradict one another for an id
are not learned from; without usable
labels of both kinds the model keeps everything that passes the base rules. An
empty table gives no rows; repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import batch, lean

BITS = 18
U = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to some other item of its document, is equal to an earlier one) for items in document order."""
    n = len(h)
    some, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        salted = t.mix64(h ^ t.mix64(doc.astype(np.uint64) + U(1)))
        order = np.argsort(salted, kind="stable")
        same = salted[order[1:]] == salted[order[:-1]]
        later[order[1:][same]] = True
        some[order[1:][same]] = True
        some[order[:-1][same]] = True
    return some, later


def base_counts(b: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a slice."""
    docs = len(offsets) - 1
    starts, ends, first = t.words(b, offsets)
    n_words = np.diff(first)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out = {"n_words": n_words, "word_chars": total(~t.SPACE[b] & ((b & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[b])}
    # lines
    breaks = np.flatnonzero(b == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(docs), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.empty(len(line_start), np.int64)
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_end[:-1] = line_start[1:] - 1
    line_end[last] = offsets[line_doc[last] + 1]
    has_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    ls, le, ld = line_start[has_word], line_end[has_word], line_doc[has_word]
    _, later = repeats(t.word_hashes(b, ls, le), ld)
    out["n_dup_lines"] = np.bincount(ld[later], minlength=docs)
    # windows of three words
    h = t.word_hashes(b, starts, ends)
    word_doc = np.repeat(np.arange(docs), n_words)
    i = np.flatnonzero(word_doc[: max(0, len(h) - 2)] == word_doc[2:])
    some, _ = repeats(t.rolled(h, i, i + 3, t.WORDS), word_doc[i])
    hit = np.zeros(len(h) + 2, bool)
    for d in range(3):
        hit[i[some] + d] = True
    out["n_repeat_words"] = np.bincount(word_doc[hit[: len(h)]], minlength=docs)
    return {k: v.astype(np.int64) for k, v in out.items()}


def byte_grams(b: np.ndarray, offsets: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, begins, ends): feature slots of all n-grams of bytes and where each document's lie; those over a border belong to none."""
    m = max(0, len(b) - n + 1)
    v = np.zeros(m, np.uint64)
    for d in range(n):
        v |= b[d : d + m].astype(np.uint64) << U(8 * d)
    slots = ((v + U(salt)) * U(0x9E3779B97F4A7C15) >> U(64 - BITS)).astype(np.int64)
    return slots, np.minimum(offsets[:-1], m), np.maximum(np.minimum(offsets[1:] - n + 1, m), np.minimum(offsets[:-1], m))


def word_grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.arange(max(0, len(h) - n + 1))
    g = h if n == 1 else t.rolled(h, i, i + n, t.WORDS)
    m = len(i)
    return (g >> U(64 - BITS)).astype(np.int64), np.minimum(first[:-1], m), np.maximum(np.minimum(first[1:] - n + 1, m), np.minimum(first[:-1], m))


def families(b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, slots, begins, ends) of each n-gram family: words in table 0, characters in table 1."""
    for n, salt in ((3, 3), (5, 5)):
        yield (1, *byte_grams(b, offsets, n, salt))
    starts, ends, first = t.words(b, offsets)
    h = t.word_hashes(b, starts, ends)
    for n in (1, 2):
        yield (0, *word_grams(h, first, n))


@dataclass
class Model:
    """Weights of both tables, the bias, and the calibration p = sigmoid(slope * margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for table, slots, lo, hi in families(b, offsets):
            total = np.concatenate([[0.0], np.cumsum(self.weights[table][slots], dtype=np.float64)])
            out += (total[hi] - total[lo]) / np.maximum(1, hi - lo)
        return out

    def probabilities(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(b, offsets) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the feature matrix of these texts; columns of table 1 follow those of table 0."""
    rows, cols, vals = [], [], []
    for first, _, b, offsets in t.slices(pa.array(texts, pa.large_string())):
        for table, slots, lo, hi in families(b, offsets):
            for d, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                if z > a:
                    c, n = np.unique(slots[a:z], return_counts=True)
                    rows.append(np.full(len(c), first + d, np.int32))
                    cols.append((c + (table << BITS)).astype(np.int32))
                    vals.append((n / (z - a)).astype(np.float32))
    return np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(cols or [np.zeros(0, np.int32)]), np.concatenate(vals or [np.zeros(0, np.float32)])


def fit(texts: list[str], labels: np.ndarray, epochs: int = 25, rate: float = 4.0, group: int = 250) -> Model:
    """Logistic regression by AdaGrad on four fifths of the rows, Platt scaling on the last fifth. Groups of rows bound the memory of a step."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros((2, 1 << BITS), np.float32), 0.0, 0.0, 40.0)
    n, y = len(texts), labels.astype(np.float64)
    held = (np.arange(n) % 5 == 4) & (n >= 20)
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    parts = [(rows, *features([texts[i] for i in rows])) for held_part in (False, True) for rows in np.array_split(np.flatnonzero(held == held_part), max(1, n // group)) if len(rows)]
    w, g2, bias, gb2 = np.zeros(2 << BITS), np.full(2 << BITS, 1e-8), 0.0, 1e-8
    margin = lambda rows, row, col, val: bias + np.bincount(row, val * w[col], minlength=len(rows))
    for _ in range(epochs):
        for rows, row, col, val in parts:
            if held[rows[0]]:
                continue
            e = (sigmoid(margin(rows, row, col, val)) - y[rows]) * weight[rows]
            g = np.bincount(col, val * e[row], minlength=len(w))
            g2 += g * g
            gb2 += e.sum() ** 2
            w -= rate * g / np.sqrt(g2)
            bias -= 0.1 * e.sum() / np.sqrt(gb2)
    m = np.zeros(n)
    for rows, row, col, val in parts:
        m[rows] = margin(rows, row, col, val)
    slope, shift = platt(m[held], y[held]) if held.any() and len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    return Model(w.astype(np.float32).reshape(2, -1), float(bias), slope, shift)


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits these labels best, with smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, margins.std())
    x, a, c = np.stack([margins / scale, np.ones(len(y))]), np.array([1.0, 0.0]), 1e-6
    for _ in range(50):
        p = sigmoid(a @ x)
        g = x @ (p - target) + c * a
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + c * np.eye(2), g)
        a = a - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0] / scale), float(a[1])


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the ids whose labels 0 and 1 agree."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return usable.agg(F.min(F.col(label).cast("int")).alias("label"), F.max(F.col(label).cast("int")).alias("most")).where("label = most").drop("most")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[list[str], np.ndarray]:
    """The texts and labels of at most ``sample`` labelled rows, those with the smallest hash of their id."""
    picked = agreed(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(sample)
    found = rows.select("text", "label").toArrow()
    return [x or "" for x in found["text"].to_pylist()], found["label"].to_numpy().astype(np.int64)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 4000, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per row of docs(doc_id, text): the base counts, base_failed, probability (of good quality), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "quality", sample)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in names), ("probability", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            parts = []
            for _, _, b, offsets in t.slices(rb.column(1)):
                c = base_counts(b, offsets)
                parts.append([*(c[x] for x in names), model.value.probabilities(b, offsets)])
            if parts:
                yield batch(schema, rb.column(0), *(np.concatenate(x) for x in zip(*parts, strict=True)))

    out = docs.mapInArrow(lean(score), "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", probability double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold)).select("doc_id", *names, "base_failed", "kept", "probability")
