"""Benchmark decontamination by the q-gram lemma (operator 1).

Benchmark items are cut into windows of at most ``window`` characters, one every
``window / 4``; an item up to that length is one window. A window of m characters
occurs in a text when some part of the text is within k = floor(rate * m) edits
of it. Such a part shares at least m + 1 - q * (k + 1) q-grams with the window, on
diagonals (text place - window place) that lie within k of each other. So shared
q-grams are counted in overlapping bands of diagonals, bands below that bound are
dropped, and the rest is verified by an alignment that is confined to the band.
Short windows use q-grams short enough for a bound of one at least (q is then
m / (k + 1)), so every window of every item is searched for and no occurrence is
missed. An excerpt of ``window * 5 / 4`` characters holds a whole window.

Bands belong to one text: the texts of a batch stand apart by more than a band is
wide, and an alignment ends where its text does. Results depend on the text
alone, not on what stands beside it.

Texts and items are compared after lower-casing, with every run of white space
as one space.

Scale. One pass over the texts and no shuffle: the benchmark is the stated query
set, held by every worker in blocks of about ``block_chars`` characters. Blocks
are searched one after the other, and the driver lets go of one before it reads
the next, so a larger benchmark means more passes, never a larger broadcast. Work
is vectorised over the q-grams of about a megabyte of text at a time.

Edge cases: null, empty and blank texts and items match nothing; items of a few
characters are searched for like any other, and are found where they stand by
chance; an item that occurs twice in a text gives one row; repeated rows give
repeated results; rows with null ids are searched like any other; extra columns
are ignored or, in without_leaks(), kept. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import Scratch, batch, lean

U = np.uint64
GRAM, FILTER_BITS = U(0x9E3779B97F4A7C15), 22
STEP = 16  # width of a band besides k
NEVER = 1 << 20  # edits of what is impossible


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the normalised texts, a 0 between them."""
    joined = "\0".join(x.replace("\0", " ") for x in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    space = (code <= 32) & (code != 0) | (code == 0xA0) | (code == 0x85) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x3000) | (code == 0x2028) | (code == 0x2029)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    code = np.where(space, np.uint32(32), code)[keep]
    ends = np.append(np.flatnonzero(code == 0), len(code))
    return code, np.concatenate([[0], ends + 1])


def qgrams(code: np.ndarray, q: int) -> np.ndarray:
    m = max(0, len(code) - q + 1)
    h = code[:m].astype(np.uint64)
    for d in range(1, q):
        h *= GRAM
        h += code[d : d + m]
    return h


class Grams:
    """The q-grams of one length of some items."""

    def __init__(self, q: int, number: np.ndarray, codes: list[np.ndarray]):
        self.q = q
        grams = [qgrams(c, q) for c in codes]
        flat = np.concatenate(grams)
        item_of = np.repeat(number.astype(np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        order = np.argsort(flat, kind="stable")
        self.item_of, self.place = item_of[order], place[order]
        keys, self.first, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = t.HashTable(keys)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * U(0xD1342543DE82EF95) >> U(64 - FILTER_BITS)).astype(np.int64)

    def shared(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every q-gram that text and items share."""
        grams = qgrams(code, self.q)
        at = np.flatnonzero(self.filter[self._slot(grams)])
        row = self.table.find(grams[at])
        at, row = at[row >= 0], row[row >= 0]
        n = self.n[row]
        entry = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.item_of[entry].astype(np.int64), self.place[entry].astype(np.int64)


def banded(what: np.ndarray, diagonal: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, key of what and band) for every band that a hit on a diagonal lies in. Bands are STEP + k wide and overlap by k."""
    band, rest = diagonal // STEP, diagonal % STEP
    hits, keys = [np.arange(len(what))], [what << 40 | band]
    for back in range(1, 1 + int(-(-k.max(initial=0) // STEP))):
        also = np.flatnonzero(rest + (back - 1) * STEP < k)
        hits.append(also)
        keys.append(what[also] << 40 | (band[also] - back))
    return np.concatenate(hits), np.concatenate(keys)


class Matcher:
    """Finds the windows of some benchmark items in texts."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, window: int):
        self.ids, self.total, codes, starts = [i for i, _ in items], {}, {}, {}
        self.step = max(1, window // 4)
        for number, (_, text) in enumerate(items):
            code, _ = normalised([text])
            code = code[1:] if len(code) and code[0] == 32 else code
            code = code[:-1] if len(code) and code[-1] == 32 else code
            if not len(code):
                continue
            starts[number] = list(range(0, max(1, len(code) - window + 1), self.step))
            if starts[number][-1] + window < len(code):
                starts[number].append(len(code) - window)
            self.total[number] = len(starts[number])
            codes[number] = code
        n = len(items)
        # the windows of an item are of one length; those of all items are numbered one after the other
        self.m = np.array([min(window, len(codes.get(i, ()))) for i in range(n)], np.int64)
        self.k = np.maximum(0, np.minimum((self.m * rate).astype(np.int64), self.m - 1))
        #: the length of each item's q-grams, short enough that an occurrence shares one of them at least
        self.q = np.minimum(q, self.m // (self.k + 1))
        self.least = self.m + 1 - self.q * (self.k + 1)
        self.grams = [Grams(int(x), number, [codes[i] for i in number.tolist()]) for x in np.unique(self.q) if x for number in [np.flatnonzero(self.q == x)]]
        self.first = np.concatenate([[0], np.cumsum([len(starts.get(i, ())) for i in range(n)])]).astype(np.int64)
        self.start = np.array([x for i in range(n) for x in starts.get(i, ())], np.int64)
        self.item = np.repeat(np.arange(n), np.diff(self.first))
        size, longest = int(self.m.max(initial=0)), max(map(len, codes.values()), default=0)
        #: diagonals between those of two texts, so that no band has both
        self.gap = -(-(longest + 2 * STEP + 2 * int(self.k.max(initial=0))) // STEP) * STEP
        self.padded = np.zeros((len(self.start), size), np.uint32)
        for row, i, x in zip(self.padded, self.item.tolist(), self.start.tolist(), strict=True):
            row[: self.m[i]] = codes[i][x : x + self.m[i]]

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, windows found, fewest edits, place of the first) for every item found in a text."""
        code, offsets = normalised(texts)
        hits = [g.shared(code) for g in self.grams if len(code) >= g.q]
        if not hits:
            return
        at, item, place = (np.concatenate(x) for x in zip(*hits, strict=True))
        text = np.searchsorted(offsets, at, "right") - 1
        diagonal = at - place + text * self.gap + (1 << 31)
        # a window has no more q-grams in a band than its item: hits in too poor bands of items go
        hit, key = banded(item, diagonal, self.k[item])
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.unique(hit[count[number] >= self.least[item[hit]]])
        at, item, place, text, diagonal = at[hit], item[hit], place[hit], text[hit], diagonal[hit]
        # the windows that a hit lies in: those that begin every `step`, and the last
        of, w = [], []
        regular = self.first[item + 1] - self.first[item]
        for back in range(-(-int(self.m.max()) // self.step) + 1):
            j = np.minimum(place // self.step, regular - 1) - back
            of.append(np.flatnonzero(j >= 0))
            w.append((self.first[item] + j)[of[-1]])
        of, w = np.concatenate(of), np.concatenate(w)
        last = self.first[item + 1] - 1  # it may begin off the steps, so that a place before it lies in it too
        of, w = np.concatenate([of, np.arange(len(item))]), np.concatenate([w, last])
        inside = (self.start[w] <= place[of]) & (place[of] + self.q[item[of]] <= self.start[w] + self.m[item[of]])
        pair = np.unique((of * (len(self.start) + 1) + w)[inside])
        of, w = pair // (len(self.start) + 1), pair % (len(self.start) + 1)
        hit, key = banded(w, diagonal[of] + self.start[w], self.k[item[of]])
        found, first, count = np.unique(key, return_index=True, return_counts=True)
        w, band, text = found >> 40, found & ((1 << 40) - 1), text[of[hit[first]]]
        ok = count >= self.least[self.item[w]]
        w, band, text = w[ok], band[ok], text[ok]
        best: dict[tuple[int, int], list] = {}
        for i in range(0, len(w), 1 << 14):  # the alignments of so many bands are in memory at once
            v, x = w[i : i + (1 << 14)], text[i : i + (1 << 14)]
            low = band[i : i + (1 << 14)] * STEP - (1 << 31) - x * self.gap
            edits, end = self.align(code, v, low, offsets[x], offsets[x + 1] - 1)
            ok = edits <= self.k[self.item[v]]
            for x1, v1, e, z in zip(x[ok].tolist(), v[ok].tolist(), edits[ok].tolist(), end[ok].tolist(), strict=True):
                place = max(0, z - int(self.m[self.item[v1]]) - int(offsets[x1]))
                b = best.setdefault((x1, int(self.item[v1])), [set(), e, place])
                b[0].add(v1)
                b[1], b[2] = min(b[1], e), min(b[2], place)
        for (x, number), (windows, e, z) in sorted(best.items()):
            yield x, number, len(windows), e, z

    def align(self, code: np.ndarray, w: np.ndarray, low: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits and end of the best occurrence of windows w on diagonals low - k .. low + STEP + 2k within code[begin:stop], all at once; those with more than k edits may be given up."""
        k, m = self.k[self.item[w]], self.m[self.item[w]]
        kmax, size = int(k.max()), int(m.max())
        width = STEP + 3 * kmax + 1
        left = low - kmax
        edits, end, rows = np.full(len(w), NEVER), np.zeros(len(w), np.int64), np.arange(len(w))
        place = left[:, None] + np.arange(size + width)
        # what lies outside the text is a 0, which no window has
        chars = np.where((place >= begin[:, None]) & (place < stop[:, None]), code[np.clip(place, 0, len(code) - 1)], np.uint32(0))
        slope = np.arange(width, dtype=np.int32)
        # column c after i characters of the window stands for the place left + c + i of the text
        d = np.where((place[:, :width] >= begin[:, None]) & (place[:, :width] <= stop[:, None]), 0, NEVER).astype(np.int32)
        window = self.padded[w]
        for i in range(1, size + 1):
            char = chars[:, i - 1 : i - 1 + width]
            up = d[:, 1:] + 1
            d = d + (char != window[:, i - 1 : i])
            outside = char == 0
            if outside.any():
                d[outside] = NEVER
                np.minimum(d[:, :-1], up, out=d[:, :-1])
                # a character of the text is skipped only inside the text
                apart = np.cumsum(outside, axis=1) * (4 * NEVER) + slope
                d = np.minimum(np.minimum.accumulate(d - apart, axis=1) + apart, NEVER).astype(np.int32)
            else:
                np.minimum(d[:, :-1], up, out=d[:, :-1])
                d -= slope
                np.minimum.accumulate(d, axis=1, out=d)
                d += slope
            done = np.flatnonzero(m == i)
            if len(done):
                c = d[done].argmin(axis=1)
                edits[rows[done]], end[rows[done]] = d[done, c], left[done] + c + i
            if i % 8 == 0:  # edits only grow
                alive = (m > i) & (d.min(axis=1) <= k)
                if 4 * alive.sum() < 3 * len(alive):
                    rows, left, m, k, d, chars, window = (x[alive] for x in (rows, left, m, k, d, chars, window))
                    if not len(rows):
                        break
        return edits, end


def blocks(benchmark: DataFrame, q: int, rate: float, window: int, block_chars: int) -> Iterator[tuple[Matcher, bool]]:
    """Matchers for parts of the benchmark of about ``block_chars`` characters, and whether each is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(size) // block_chars)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text")
        yield Matcher([(r[0], r[1]) for r in part.collect()], q, rate, window), i + 1 == n


def rows_of(column: pa.Array, limit: int = t.SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``limit`` bytes; a null counts as an empty text."""
    for first, end, _, _ in t.slices(column, limit):
        yield first, column.slice(first, end - first).fill_null("").to_pylist()


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, window: int = 64, block_chars: int = 1 << 19) -> DataFrame:
    """(doc_id, item_id, windows_found, windows, edits, place) for every benchmark item of which docs(doc_id, text) hold a window."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc, out, scratch = docs.sparkSession.sparkContext, None, None
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "item_id", "windows_found", "windows", "edits", "place")])
    ddl = "doc_id long, item_id long, windows_found long, windows long, edits long, place long"
    for matcher, last in blocks(benchmark, q, rate, window, block_chars):
        shared = sc.broadcast(matcher)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for rb in batches:
                ids, found = rb.column(0).to_pylist(), []
                for first, texts in rows_of(rb.column(1)):
                    found += [(ids[first + x], m.ids[item], n, m.total[item], e, place) for x, item, n, e, place in m.find(texts)]
                if found:
                    yield batch(schema, *zip(*found, strict=True))

        part = docs.mapInArrow(lean(search), ddl)
        if not last:  # written before the next block is read
            scratch = scratch or Scratch(docs.sparkSession)
            part = scratch.save(part)
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, window: int = 64, block_chars: int = 1 << 19) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    at, scratch, before = docs.columns.index("text"), None, None
    for matcher, last in blocks(benchmark, q, rate, window, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                keep = np.ones(rb.num_rows, bool)
                for first, texts in rows_of(rb.column(at)):
                    for x, *_ in shared.value.find(texts):
                        keep[first + x] = False
                yield rb.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(clean), docs.schema)
        if not last:  # written before the next block is read
            scratch = scratch or Scratch(docs.sparkSession)
            docs = scratch.save(docs)
            shared.destroy()
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
