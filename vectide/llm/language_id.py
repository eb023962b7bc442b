"""Language identification of mixed-language text (operator 5).

Every word gets a score per language, a naive Bayes sum over hashed letter
trigrams (with word borders). The script of a word, from its code point ranges,
narrows the candidates to the languages that were learned with that script. A
Viterbi pass with a penalty for switching then labels each word, so a text falls
into spans of one language. The text's language is the one whose spans hold most
letters, its score their share of all letters.

The Viterbi pass is a max-plus scan: texts are cut into blocks of 64 words, the
transfer matrices of all blocks are computed side by side, combined along each
text, and traced back per block, so a very long text costs no Python loop over
its words.

Trigram counts are taken over all training rows; a task sends at most one number
per (slot, language). Every label is learned: the model has 2**17 slots a language
up to 2**23 numbers, fewer slots a language beyond, and 2**12 at least, so its size
depends on the number of labels, never on the corpus. With many languages slices are
smaller, and the Viterbi pass goes along the words of all texts of a slice at once,
as transfer matrices would grow with the square of their number.

Edge cases: a text that is null or has no letter is ``und`` with score 0; words
without letters side with their neighbours; rows whose language is null or whose
fold is held out are not learned from; without training rows every text is
``und``. Ties go to the language that sorts first. Rows with null ids count as
not held out. An empty table gives no rows; repeated rows are kept; extra columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import batch, crc_mod, lean

U = np.uint64
STEP = 64
# First code points of ranges of scripts (Unicode blocks), 0 for none.
SCRIPTS = [(0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 7), (0x900, 8), (0x980, 9), (0xA00, 10), (0xA80, 11), (0xB00, 12), (0xB80, 13), (0xC00, 14), (0xC80, 15), (0xD00, 16), (0xD80, 17), (0xE00, 18), (0xE80, 19), (0xF00, 20), (0x1000, 21), (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x1380, 25), (0x1780, 26), (0x1800, 27), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2E80, 28), (0x3040, 29), (0x3100, 28), (0x3130, 23), (0x3190, 28), (0xAC00, 23), (0xD7B0, 0), (0xF900, 28), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 29), (0xFFA0, 23), (0x10000, 0), (0x20000, 28), (0x40000, 0)]
N_SCRIPTS = 30
#: What a switch of language costs, in natural logarithms of probability.
PENALTY = 10.0

FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


@cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def letters_and_scripts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is the first byte of a letter, places of letters outside ASCII, their scripts)."""
    is_letter = (FOLDED[b] != 0x20) & (b < 128)
    lead = np.flatnonzero(b >= 0xC0)
    first, n = b[lead].astype(np.int64), len(b)
    at = lambda k: (b[np.minimum(lead + k, n - 1)] & 0x3F).astype(np.int64)
    two, three = (first & 0x1F) << 6 | at(1), (first & 0x0F) << 12 | at(1) << 6 | at(2)
    four = (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)
    point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))
    ok = letter_table()[point]
    lead, point = lead[ok], point[ok]
    is_letter[lead] = True
    ranges = np.array([x for x, _ in SCRIPTS])
    return is_letter, lead, np.array([s for _, s in SCRIPTS])[np.searchsorted(ranges, point, "right") - 1]


@dataclass
class WordView:
    """The words of a slice with what the model needs of them."""

    first: np.ndarray  # first word of each document
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # 1 for Latin and words without letters
    begins: np.ndarray  # of each word's trigrams
    ends: np.ndarray
    slots: np.ndarray


def view(b: np.ndarray, offsets: np.ndarray, bits: int) -> WordView:
    starts, ends, first = t.words(b, offsets)
    m = FOLDED[b]
    before, after = np.full(len(b), 0x20, np.uint8), np.full(len(b), 0x20, np.uint8)
    before[1:], after[:-1] = m[:-1], m[1:]
    edge = offsets[(offsets > 0) & (offsets < len(b))]
    before[edge] = after[edge - 1] = 0x20
    used = np.flatnonzero(m != 0x20)
    key = before[used].astype(np.uint64) | m[used].astype(np.uint64) << U(8) | after[used].astype(np.uint64) << U(16)
    slots = ((key + U(1)) * U(0x9E3779B97F4A7C15) >> U(64 - bits)).astype(np.int64)
    is_letter, places, scripts = letters_and_scripts(b)
    total = np.concatenate([[0], np.cumsum(is_letter)])
    letters = total[ends] - total[starts]
    script = np.ones(len(starts), np.int64)
    if len(starts):
        other = scripts > 1
        word = np.searchsorted(starts, places[other], "right") - 1
        script[word[::-1]] = scripts[other][::-1]  # the first letter outside Latin decides
    return WordView(first, letters, script, np.searchsorted(used, starts), np.searchsorted(used, ends), slots)


@dataclass
class Model:
    languages: list[str]
    bits: int
    weights: np.ndarray  # (slots, languages): log probabilities
    allowed: np.ndarray  # (scripts, languages): 0, or a penalty where the language lacks the script
    known: np.ndarray  # of each script, whether some language has it

    @property
    def slice_bytes(self) -> int:
        """Bytes of text whose words are scored at once."""
        return max(1 << 12, t.SLICE_BYTES * 16 // max(16, len(self.languages)))

    def word_scores(self, v: WordView) -> np.ndarray:
        out = self.allowed[v.script] * (v.letters > 0)[:, None]
        room, lo = max(1, (1 << 24) // len(self.languages)), 0
        while lo < len(out):  # as many words at a time as have so many trigrams
            hi = max(lo + 1, int(np.searchsorted(v.ends, v.begins[lo] + room, "right")))
            w = self.weights[v.slots[v.begins[lo] : v.ends[hi - 1]]]
            total = np.zeros((len(w) + 1, w.shape[1]))
            np.cumsum(w, axis=0, dtype=np.float64, out=total[1:])
            out[lo:hi] += total[v.ends[lo:hi] - v.begins[lo]] - total[v.begins[lo:hi] - v.begins[lo]]
            lo = hi
        return out


#: States up to which the matrices of a scan are small.
FEW = 16


def viterbi_along(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() for many states: along the words, all documents side by side."""
    n, states = scores.shape
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    longest = counts[order]
    came, delta, own = np.zeros((n, states), np.int32), np.zeros((len(counts), states)), np.arange(states)
    for k in range(int(longest[0])):
        d = order[: int(np.searchsorted(-longest, -k))]  # documents with a word k
        switched = delta[d].max(axis=1)[:, None] - penalty
        change = switched > delta[d]
        came[first[d] + k] = np.where(change, delta[d].argmax(axis=1)[:, None], own)
        delta[d] = np.where(change, switched, delta[d]) + scores[first[d] + k]
    out, state = np.zeros(n, np.int64), delta.argmax(axis=1)
    for k in range(int(longest[0]) - 1, -1, -1):
        d = order[: int(np.searchsorted(-longest, -k))]
        out[first[d] + k] = state[d]
        state[d] = came[first[d] + k, state[d]]
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, documents being words first[d] .. first[d + 1]."""
    n, states = scores.shape
    if not n or states == 1:
        return np.zeros(n, np.int64)
    if states > FEW:
        return viterbi_along(scores, first, penalty)
    counts = np.diff(first)
    blocks = -(-counts // STEP)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(block_first[-1])
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n) - first[doc]
    where = (block_first[doc] + inside // STEP) * STEP + inside % STEP
    s = np.zeros((total * STEP, states))
    s[where] = scores
    s = s.reshape(total, STEP, states)
    # transfer matrices: best gain from a label before the block to one at its end
    m = np.where(np.eye(states, dtype=bool), 0.0, -np.inf)[None].repeat(total, axis=0)
    for k in range(STEP):
        m = np.maximum(m, m.max(axis=2, keepdims=True) - penalty) + s[:, k, None, :]
    # along each document
    enter = np.zeros((total, states))
    leave_from = np.zeros((total, states), np.int64)
    value = np.zeros((len(counts), states))
    for k in range(int(blocks.max())):
        d = np.flatnonzero(blocks > k)
        at = block_first[d] + k
        enter[at] = value[d]
        reach = value[d][:, :, None] + m[at]
        leave_from[at] = reach.argmax(axis=1)
        value[d] = reach.max(axis=1)
    end = np.zeros(total, np.int64)
    state = value.argmax(axis=1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        d = np.flatnonzero(blocks > k)
        at = block_first[d] + k
        end[at] = state[d]
        state[d] = leave_from[at, state[d]]
    # within each block
    came = np.zeros((STEP, total, states), np.int32)
    delta, own = enter, np.arange(states)
    for k in range(STEP):
        best = delta.argmax(axis=1)
        switched = delta.max(axis=1)[:, None] - penalty
        change = switched > delta
        came[k] = np.where(change, best[:, None], own)
        delta = np.where(change, switched, delta) + s[:, k]
    out = np.zeros((total, STEP), np.int64)
    state, rows = end, np.arange(total)
    for k in range(STEP - 1, -1, -1):
        out[:, k] = state
        state = came[k, rows, state]
    return out.reshape(-1)[where]


def learn(rows: DataFrame) -> Model | None:
    """A model from rows(text, lang); counts come from all of them."""
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    bits = max(12, min(17, 23 - (len(languages) - 1).bit_length()))
    number = {x: i for i, x in enumerate(languages)}
    width = len(languages)
    schema = pa.schema([("slot", pa.int32()), ("language", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((1 << bits) * width, np.int64), np.zeros(N_SCRIPTS * width, np.int64)
        for rb in batches:
            label = np.array([number.get(x, -1) for x in rb.column(1).to_pylist()], np.int64)
            for lo, hi, b, offsets in t.slices(rb.column(0)):
                v = view(b, offsets, bits)
                word_label = np.repeat(label[lo:hi], np.diff(v.first))
                of_gram = np.repeat(word_label, v.ends - v.begins)
                keep = of_gram >= 0
                grams += np.bincount(v.slots[keep] * width + of_gram[keep], minlength=len(grams))
                keep = (word_label >= 0) & (v.letters > 0)
                scripts += np.bincount(v.script[keep] * width + word_label[keep], minlength=len(scripts))
        both = np.concatenate([grams, scripts])
        at = np.flatnonzero(both)
        yield batch(schema, (at // width).astype(np.int32), (at % width).astype(np.int32), both[at])

    counts = rows.select("text", "lang").mapInArrow(lean(count), "slot int, language int, n long").groupBy("slot", "language").agg(F.sum("n").alias("n")).toPandas()  # a row per slot and language at most
    table = np.zeros(((1 << bits) + N_SCRIPTS, width))
    table[counts["slot"].to_numpy(np.int64), counts["language"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    grams, scripts = table[: 1 << bits], table[1 << bits :]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * (1 << bits)))
    weights -= weights.max(axis=1, keepdims=True)  # what all languages share decides nothing
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
    allowed = np.where(used | ~used.any(axis=1, keepdims=True), 0.0, -30.0)
    return Model(languages, bits, weights.astype(np.float32), allowed, used.any(axis=1))


def shares(b: np.ndarray, offsets: np.ndarray, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray, WordView, np.ndarray, np.ndarray]:
    """(language number or -1, its share of the letters) of each document of a slice, and the words with their documents and labels."""
    n, width = len(offsets) - 1, len(model.languages)
    v = view(b, offsets, model.bits)
    label = viterbi(model.word_scores(v), v.first, penalty)
    doc = np.repeat(np.arange(n), np.diff(v.first))
    share = np.bincount(doc * width + label, v.letters, n * width).reshape(n, width)
    letters = share.sum(axis=1)
    best = np.where(letters > 0, share.argmax(axis=1), -1)
    return best, np.where(best >= 0, share.max(axis=1) / np.maximum(1, letters), 0.0), v, doc, label


def span_starts(doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The first words of the spans of one label in one document."""
    new = np.ones(len(doc), bool)
    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def labelled_spans(docs: DataFrame, model: Model | None, penalty: float) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans, spans [(start_word, end_word, lang)]) of docs(doc_id, text)."""
    span = pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", pa.list_(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*(model.languages if model else []), "und"], dtype=object)
        width = len(names) - 1
        for rb in batches:
            parts: list[tuple] = []
            for lo, hi, b, offsets in t.slices(rb.column(1), model.slice_bytes if model else t.SLICE_BYTES):
                n = hi - lo
                if not width:
                    z = np.zeros(0, np.int64)
                    parts.append((np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), z, z, z))
                    continue
                best, score, v, doc, label = shares(b, offsets, model, penalty)
                at = span_starts(doc, label)
                start = at - v.first[doc[at]]
                end = np.append(at[1:], len(doc)) - v.first[doc[at]]
                parts.append((best, score, np.bincount(doc[at], minlength=n), start, end, label[at]))
            if parts:
                best, score, n_spans, start, end, label = (np.concatenate(x) for x in zip(*parts, strict=True))
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(names[label.astype(np.int64)], pa.string())], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), spans).cast(pa.list_(span))
                yield batch(schema, rb.column(0), pa.array(names[best], pa.string()), score, n_spans, lists)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, lang_pred string, score double, n_spans long, spans array<struct<start_word: long, end_word: long, lang: string>>")


def language_ids(docs: DataFrame, folds: int = 4, held_out: int = 2, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans, spans) of docs(doc_id, text, lang), learned from the other folds."""
    fold = F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False))
    rows = docs.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = labelled_spans(docs, learn(rows), penalty)
    return found.withColumn("held_out", fold).select("doc_id", "held_out", "lang_pred", "score", "n_spans", "spans")


def of_known_language(docs: DataFrame, min_share: float = 0.5, least_words: int = 5) -> DataFrame:
    """The rows of docs, all columns, whose text is in the languages of their ``lang`` column, which all of them teach.

    A text is rejected if it has no letters, or if less than ``min_share`` of them are in spans of known languages. A span
    counts from ``least_words`` on or if it is the whole text, as the labels of what is in no language change with every few
    words; words of a script that no language was learned with don't count. Texts of several known languages stay.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared, at = docs.sparkSession.sparkContext.broadcast(learn(rows)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rb in batches:
            keep = np.zeros(rb.num_rows, bool)
            for lo, hi, b, offsets in t.slices(rb.column(at), model.slice_bytes) if model else ():
                best, _, v, doc, label = shares(b, offsets, model, PENALTY)
                start = span_starts(doc, label)
                size = np.diff(np.append(start, len(doc)))
                long = (size >= least_words) | (size == np.diff(v.first)[doc[start]])
                fits = np.bincount(doc, v.letters * (model.known[v.script] & np.repeat(long, size)), hi - lo)
                keep[lo:hi] = (best >= 0) & (fits >= min_share * np.bincount(doc, v.letters, hi - lo))
            yield rb.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
