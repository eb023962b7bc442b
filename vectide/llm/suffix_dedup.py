"""Repeated passages by a sparse suffix array (operator 8).

A passage of ``length`` words counts as repeated when it stands at two places,
of one document or of two. The suffix array is sparse: of all word positions
only minimisers are kept, the positions whose k-gram has the smallest hash of
some stretch of ``length - k + 1`` k-grams. The choice depends on content alone,
so equal passages keep the same suffixes: every passage of ``length`` words holds
one that it "owns", at the same place in every copy.

1. Every task hashes its texts and reports the k-grams of kept suffixes; those
   that occur once in the corpus can't lie in a repeated passage and go.
2. For the rest, the suffix is extended left and right: all passages that own it
   are hashed. Kept suffixes are sorted by their k-gram, so copies become
   neighbours, and are compared passage by passage. The neighbours in the order of
   suffixes alone don't do: the longest match to the right may be with one copy and
   the match to the left with another.
3. Repeated passages of a document are merged into maximal spans.

Scale. Kept suffixes are about 2 / (length - k + 2) of all words. Within a task
equal stretches are settled at once and only the first goes on, so a passage
that millions of documents share costs a row per task. A k-gram with more than
``hot`` occurrences is settled in two steps: every task compares all its copies,
and the first of each passage goes on alone, dealt out by passage, where the
tasks' rows are read as a stream. So no task gets all of one k-gram and none
holds all rows of one passage. Passages are known by 64-bit hashes.

Words are maximal runs of bytes other than space and 09-0D; they are compared as
they are, case included. Edge cases: null, empty and short texts have no
passages; rows are told apart by (doc_id, text), so repeated rows count as
copies of each other and get the same spans, once, and without_repeats() cuts all
but one of them; null ids work like any other id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vectide.llm import _text as t
from vectide.llm._spark import Scratch, batch, lean, released

U = np.uint64


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window of w values."""
    best = np.arange(len(v))
    have = 1
    while have < w:  # windows of `have` values become windows of `have + step`
        step = min(have, w - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(v[b] < v[a], b, a)
        have += step
    return best


class Stretches:
    """The passages of a slice of documents, by the suffix that owns them.

    Row r stands for the passages that start at first[r] .. first[r] + count[r] - 1
    (word numbers in the slice), all owned by the suffix at[r] with k-gram gram[r].
    """

    def __init__(self, b: np.ndarray, offsets: np.ndarray, length: int, k: int):
        starts, ends, self.doc_first = t.words(b, offsets)
        h, w = t.word_hashes(b, starts, ends), length - k + 1
        n = len(h)
        ok = np.zeros(max(0, n - length + 1), bool)
        for lo, hi in zip(self.doc_first[:-1], self.doc_first[1:], strict=True):
            if hi - lo >= length:
                ok[lo : hi - length + 1] = True
        place = np.flatnonzero(ok)
        i = np.arange(max(0, n - k + 1))
        grams = t.rolled(h, i, i + k, t.WORDS)
        own = sliding_argmin(grams, w)[place] if len(place) else place
        new = np.ones(len(place), bool)
        new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
        r = np.flatnonzero(new)
        self.first, self.at = place[r], own[r]
        self.count = np.diff(np.append(r, len(place)))
        self.gram = grams[self.at]
        self.doc = np.searchsorted(self.doc_first, self.first, "right") - 1
        self.h, self.length = h, length

    def passages(self) -> np.ndarray:
        """The hash of the passage at each word number of the slice."""
        i = np.arange(max(0, len(self.h) - self.length + 1))
        return t.rolled(self.h, i, i + self.length, t.WORDS)


def kept_suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, gram, first): the kept suffixes of every row; key names (doc_id, text)."""
    schema = pa.schema([("key", pa.int64()), ("gram", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys = rb.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, b, offsets in t.slices(rb.column(1)):
                s = Stretches(b, offsets, length, k)
                yield batch(schema, keys[lo:hi][s.doc], t.signed(s.gram), (s.first - s.doc_first[s.doc]).astype(np.int32))

    return docs.select("key", "text").mapInArrow(lean(run), "key long, gram long, first int")


def order(place: tuple) -> tuple:
    """Sorts places (doc_id, key, word) as Spark does, null ids first."""
    return (place[0] is not None, place[0] or 0, *place[1:])


def states(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, copies, hash) of the passages of a group [(copies, hashes)] in the order of their places.

    Of every passage: whether no one before has it, how many copies of it there are, and its hash.
    """
    flat = np.concatenate([np.frombuffer(h, np.uint64) for _, h in group])
    weights = np.repeat([c for c, _ in group], [len(h) // 8 for _, h in group])
    _, at, number = np.unique(flat, return_index=True, return_inverse=True)
    return at[number] == np.arange(len(flat)), np.bincount(number, weights)[number], flat


def runs_of(state: np.ndarray) -> Iterator[tuple[int, int]]:
    """[begin, end) of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(state)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(state)], strict=True)


def extended(docs: DataFrame, length: int, k: int, hot: int) -> DataFrame:
    """(sort_key, doc_id, key, start, count, hashes, copies) for docs(doc_id, key, text, stretches [(first, uses)]).

    hashes: those of the passages from ``start`` on, of which this task has ``copies``; without hashes, this task has an
    earlier copy of each. sort_key is the k-gram or, where that is hot, the passage.
    """
    schema = pa.schema([("sort_key", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("hashes", pa.binary()), ("copies", pa.int32())])

    def settled_here(places: list[tuple[tuple, int, bytes]]) -> Iterator[tuple]:
        """Rows of the stretches (first place, copies, hashes) of a hot k-gram."""
        places.sort(key=lambda x: order(x[0]))
        first, copies, flat = states([x[1:] for x in places])
        begin = 0
        for (doc_id, key, start), _, blob in places:
            n = len(blob) // 8
            for a, z in runs_of(first[begin : begin + n]):
                if not first[begin + a]:
                    yield 0, doc_id, key, start + a, z - a, None, 0
                else:
                    for i in range(begin + a, begin + z):
                        x = flat[i : i + 1]
                        yield int(x.view(np.int64)[0]), doc_id, key, start + i - begin, 1, x.tobytes(), int(copies[i])
            begin += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            out, many = [], {}
            for (gram, is_hot, blob), places in found.items():
                places.sort(key=order)
                # the first stands for all; the others are known to be repeated and not first
                out += [(0, *x, len(blob) // 8, None, 0) for x in places[1:]]
                if is_hot:
                    many.setdefault(gram, []).append((places[0], len(places), blob))
                else:
                    out.append((gram, *places[0], len(blob) // 8, blob, len(places)))
            for places in many.values():
                out += settled_here(places)
            found.clear()
            held = 0
            for i in range(0, len(out), 20_000):
                yield batch(schema, *zip(*out[i : i + 20_000], strict=True))

        for rb in batches:
            ids, keys, wanted = rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(3)
            for lo, hi, b, offsets in t.slices(rb.column(2)):
                s = Stretches(b, offsets, length, k)
                hashes = s.passages()
                begin = np.searchsorted(s.doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    mine = slice(begin[d], begin[d + 1])
                    firsts = s.first[mine] - s.doc_first[d]
                    uses = dict(zip(*(c.tolist() for c in wanted[lo + d].values.flatten()), strict=True))
                    for r in np.flatnonzero(np.isin(firsts, np.fromiter(uses, np.int64, len(uses)))).tolist():
                        i = begin[d] + r
                        block, first = hashes[s.first[i] : s.first[i] + s.count[i]], int(firsts[r])
                        found.setdefault((int(s.gram[i].view(np.int64)), uses[first] > hot, block.tobytes()), []).append((ids[lo + d], keys[lo + d], first))
                        held += 1
                if held > 60_000:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "key", "text", "stretches").mapInArrow(lean(run), "sort_key long, doc_id long, key long, start int, count int, hashes binary, copies int")


def compared(rows: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, removable): runs of passages (numbers of their first words) that are repeated.

    removable: another place has the passage first, in the order of doc_id (null first), key and word number.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("removable", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, passage = None, [], None
        out: list[tuple] = []

        def flush() -> None:
            if not group or len(group) == 1 and group[0][5] < 2:
                return
            first, copies, _ = states([(g[5], g[4]) for g in group])
            state = np.where(copies > 1, 2 - first, 0)
            begin = 0
            for doc_id, k, start, count, _, _ in group:
                for a, z in runs_of(state[begin : begin + count]):
                    if state[begin + a]:
                        out.append((doc_id, k, start + a, start + z - 1, bool(state[begin + a] == 2)))
                begin += count

        for rb in batches:
            for sort_key, *g in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                doc_id, k, start, count, blob, copies = g
                if sort_key != key:
                    flush()
                    key, group, passage = sort_key, [], None
                if count == 1 and int.from_bytes(blob, "little", signed=True) == sort_key:
                    # a passage that is dealt out alone: its rows come in the order of their places and needn't be held
                    if passage is None:
                        passage = (doc_id, k, start, start, False)
                        if copies > 1:
                            out.append(passage)
                            passage = ()
                        continue
                    if passage:
                        out.append(passage)
                        passage = ()
                    out.append((doc_id, k, start, start, True))
                else:
                    group.append(g)
            if out:
                yield batch(schema, *zip(*out, strict=True))
                out.clear()
        flush()
        if out:
            yield batch(schema, *zip(*out, strict=True))

    columns = rows.select("sort_key", "doc_id", "key", "start", "count", "hashes", "copies")
    return columns.repartition("sort_key").sortWithinPartitions("sort_key", "doc_id", "key", "start").mapInArrow(lean(run), "doc_id long, key long, start int, end int, removable boolean")


def merged(runs: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, start_word, end_word): maximal spans of words [start, end) that the runs of passages cover."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before) + length, F.lit(True))
    spans = runs.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(w)).groupBy("doc_id", "key", "span")
    return spans.agg(F.min("start").cast("long").alias("start_word"), (F.max("end") + length).cast("long").alias("end_word")).drop("span")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with (doc_id, text) as they are used here and their key."""
    d = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return d.withColumn("key", F.xxhash64("doc_id", "text"))


def repeated_runs(docs: DataFrame, length: int = 50, k: int | None = None, hot: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, key, start, end, removable) of the repeated passages of docs(doc_id, text, key)."""
    k = k or max(1, length * 2 // 5)
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "key", "text")
    kept = scratch.save(kept_suffixes(docs, length, k))
    # as a table of its own, so the join has an exchange on either side and Spark can split a k-gram that is in many documents
    uses = scratch.save(kept.groupBy("gram").agg(F.count("*").alias("uses")).where("uses > 1"))
    stretches = kept.join(uses, "gram").groupBy("key").agg(F.collect_set(F.struct("first", "uses")).alias("stretches"))
    rows = scratch.save(extended(docs.join(stretches, "key"), length, k, hot))
    scratch.drop(kept, uses)
    settled = rows.where("hashes is null").select("doc_id", "key", "start", (F.col("start") + F.col("count") - 1).alias("end"), F.lit(True).alias("removable"))
    return compared(rows.where("hashes is not null")).unionAll(settled)


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal spans of words that repeated passages of ``length`` words cover."""
    spans = merged(repeated_runs(keyed(docs), length), length)
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def cut(text: str, spans: list[dict], length: int) -> str:
    """text without the words of the spans, each with the white space before it; the span from -1 is all words if they are ``length`` at least."""
    b = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = t.words(b, np.array([0, len(b)]))
    if spans[0]["start_word"] < 0:
        if len(starts) < length:
            return text
        spans = [{"start_word": 0, "end_word": len(starts)}]
    out, at = [], 0
    for s in spans:
        out.append(b[at : ends[s["start_word"] - 1] if s["start_word"] else 0])
        at = ends[s["end_word"] - 1]
    out.append(b[at:] if at < ends[-1] else b[:0])
    kept = np.concatenate(out).tobytes()
    return kept.lstrip(b"\t\n\v\f\r ").decode() if spans[0]["start_word"] == 0 else kept.decode()


def removable_spans(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(span_id, span_key, spans [(start_word, end_word)]) of rows(doc_id, key, text): what others have first. Written; all that led to it is gone."""
    work = Scratch(rows.sparkSession)
    found = merged(repeated_runs(rows, length, scratch=work).where("removable"), length)
    spans = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    out = scratch.save(spans.select(F.col("doc_id").alias("span_id"), F.col("key").alias("span_key"), "spans"))
    work.drop()
    return out


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with all but the first place of every repeated passage cut out of ``text``; n_chars, if there is one, follows.

    Of rows with the same doc_id and text one counts as first and keeps what a single row would; from the others all
    passages go. A cut span goes with the white space before it; other text stays byte by byte. A text of which no word
    is left becomes empty. Rows are neither dropped nor reordered into one another.
    """
    schema_in, scratch = docs.schema, Scratch(docs.sparkSession)
    # the row as it came is one column, so its names can't clash with those in use here
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    twice = scratch.save(rows.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("key").alias("twice_key")))
    others = None
    if not twice.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("twice_id")) & (F.col("key") == F.col("twice_key"))
        numbered = scratch.save(rows.join(twice, same, "left_semi").withColumn("number", F.monotonically_increasing_id()))
        first = numbered.groupBy("doc_id", "key").agg(F.min("number").alias("first")).select("first")
        once = numbered.join(first, F.col("number") == F.col("first"), "left_semi").drop("number")
        others = numbered.join(first, F.col("number") == F.col("first"), "left_anti").drop("number")
        rows = rows.join(twice, same, "left_anti").unionAll(once)
    spans = removable_spans(rows, length, scratch)
    released(docs.sparkSession)
    # by one way at every size: texts are shuffled once, and spans are not broadcast where they happen to be few
    rows = rows.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left").select("whole", "spans")
    if others is not None:
        everything = F.array(F.struct(F.lit(-1).cast("long").alias("start_word"), F.lit(-1).cast("long").alias("end_word")))
        rows = rows.unionAll(others.select("whole", everything.alias("spans")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(0).field(at).cast(pa.string())
            out = [cut(x.as_py(), s, length) if s and x.is_valid else None for x, s in zip(texts, rb.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.string())], names=["whole", "cut_text"])

    done = rows.mapInArrow(lean(run), StructType([StructField("whole", schema_in), StructField("cut_text", StringType())]))
    columns = []
    for f in schema_in.fields:
        value = F.col("whole")[f.name]
        if f.name == "text":
            value = F.coalesce("cut_text", value)
        elif f.name == "n_chars":
            value = F.when(F.col("cut_text").isNotNull(), F.length("cut_text")).otherwise(value)
        columns.append(value.cast(f.dataType).alias(f.name))
    return done.select(*columns)
