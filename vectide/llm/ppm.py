"""Language-model scores by prediction by partial matching (operator 2).

The model is a trie of byte contexts up to ``order`` bytes, counted over the
training texts. A symbol is predicted in the longest context that the trie has;
a symbol not seen there costs an escape, whose probability is estimated by the
number of distinct symbols seen (method C), and is then predicted in the next
shorter context, from which the symbols of the longer one are excluded. Below the
empty context stands a uniform choice among the symbols never seen. With full
counts the symbols of a context are a subset of those of its suffix, so the cost
of every escape belongs to one context and is worked out when the trie is built;
probabilities sum to one at every step. Scoring is then table look-ups for all
places of a batch at once, and sums per text.

Texts are taken as UTF-8 bytes with A-Z in lower case, followed by an end symbol;
the contexts of a text begin with start symbols. Both are bytes that UTF-8 never
has. For comparison each text also gets the smoothed unigram score of its words.

Scale. Nothing of the model is dropped: it has every n-gram of the training texts.
Texts are dealt out to homes and contexts of three bytes to parts, both as many as
the input needs; texts, n-grams and costs travel in compressed blocks. A home sends each part the distinct n-grams of its texts that fall
to the part, with their counts in training texts; the part has whole sub-tries of
its contexts, works out the cost of every n-gram it was sent and answers each home;
a home then scores its texts by look-up among the answers to its own n-grams. So a
task holds the n-grams of one home, with its texts, or of one part, never the trie.
Rows are dealt to homes by task too, so that a row that is repeated in all tasks
doesn't end up in one home. N-grams of up to
three bytes, whose number the alphabet bounds, go to every part. Word counts are
looked up in two tiers: a broadcast table of the ``hot_words`` most frequent words
and, for the rest, one join of the distinct rare words of each text.

Words and n-grams of words are known by 64-bit hashes. Edge cases: a null text
counts as empty and still has its end symbol; rows with null ids are scored and,
belonging to no held-out fold, learned from; without training rows every symbol
and every word is uniform; repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import Scratch, batch, crc_mod, given_back, lean

U = np.uint64
START, END, SYMBOLS = 0xFE, 0xFF, 255  # the bytes 00-FD and the end; a start is never predicted
#: Bytes of context by which the trie is dealt out; bytes of text a home.
SPLIT, HOME_BYTES = 3, 1 << 24


def streams(column: pa.Array, order: int, limit: int = t.SLICE_BYTES // 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, n-grams, begins, lower-cased bytes and offsets) of slices of texts.

    n-grams: at every predicted place the last order + 1 bytes, the place's own lowest; each text has its bytes and an end.
    """
    for lo, hi, raw, offsets in t.slices(column, limit):
        b = t.LOWER[raw]
        docs = hi - lo
        # `order` starts before each text, one end after it
        shift = np.arange(docs, dtype=np.int64) * (order + 1) + order
        s = np.full(len(b) + docs * (order + 1), START, np.uint8)
        s[np.arange(len(b)) + np.repeat(shift, np.diff(offsets))] = b
        ends = offsets[1:] + shift
        s[ends] = END
        g = np.zeros(len(s), np.uint64)
        for d in range(order + 1):
            g[d:] |= s[: len(s) - d].astype(np.uint64) << U(8 * d)
        places = np.ones(len(s), bool)
        if order:
            places[(np.concatenate([[0], ends[:-1] + 1])[:, None] + np.arange(order)).ravel()] = False
        yield lo, hi, g[places], offsets[:-1] + np.arange(docs), (b, offsets)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) with their sums."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first, dtype=np.int64)


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n) rows of each task: kind 0 n-grams of order + 1 bytes, kind 1 words, kind 2 the end symbol of texts."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        texts = 0

        def send(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield batch(schema, np.full(len(keys[part]), kind, np.int8), t.signed(keys[part]), n[part])

        for rb in batches:
            for lo, hi, grams, _, (b, offsets) in streams(rb.column(0), order):
                starts, ends, _ = t.words(b, offsets)
                texts += hi - lo
                for kind, keys in ((0, grams), (1, t.word_hashes(b, starts, ends))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if len(held[kind]) == 8:
                        held[kind] = [merged(held[kind])]
                        if len(held[kind][0][0]) > 1_000_000:
                            yield from send(kind, *held[kind].pop())
        for kind, parts in held.items():
            if parts:
                yield from send(kind, *merged(parts))
        yield batch(schema, np.array([2], np.int8), [0], [texts])

    return docs.select("text").mapInArrow(lean(run), "kind byte, key long, n long")


class Trie:
    """The compiled model: per order j the n-grams of j + 1 bytes and the contexts of j bytes, with their log10 costs."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[j]: (n-grams of j + 1 bytes as numbers, counts), closed under taking suffixes."""
        self.order, self.seen = len(levels) - 1, len(levels[0][0])
        self.nodes: list[t.HashTable] = []
        self.contexts: list[t.HashTable] = []
        self.count, self.here, self.escape = [], [], []
        #: of a context: the weight left in its suffix without its own symbols, and the escape from there
        self.rest, self.step = [], []
        total = kinds = n = None
        for j, (grams, counts) in enumerate(levels):
            shorter_total, shorter_kinds, shorter_n = total, kinds, n
            n = counts.astype(np.float64)
            context, at = np.unique(grams >> U(8), return_inverse=True)
            add = lambda w, at=at, m=len(context): np.bincount(at, weights=w, minlength=m)
            total, kinds = add(n), add(None).astype(np.float64)
            self.nodes.append(t.HashTable(grams))
            self.contexts.append(t.HashTable(context))
            self.count.append(np.log10(n))
            self.here.append(np.log10(n) - np.log10(total + kinds)[at])
            self.escape.append(np.log10(kinds) - np.log10(total + kinds))
            if j:
                lower = self.nodes[j - 1].find(grams & U((1 << (8 * j)) - 1))
                shorter = self.contexts[j - 1].find(context & U((1 << (8 * (j - 1))) - 1))
                fresh = shorter_kinds[shorter] - kinds
                rest = shorter_total[shorter] - add(shorter_n[lower]) + fresh
                self.rest.append(np.log10(np.maximum(rest, 1)))
                # with no symbol left in the shorter context the escape from it is certain
                self.step.append(np.where(fresh > 0, np.log10(np.maximum(fresh, 1)) - np.log10(np.maximum(rest, 1)), 0.0))
            else:
                self.rest.append(np.zeros(len(context)))
                self.step.append(np.zeros(len(context)))
        self.uniform = -np.log10(max(1, SYMBOLS - self.seen))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability at each place, from its n-gram of order + 1 bytes."""
        out = np.zeros(len(grams))
        top = self.nodes[self.order].find(grams)
        hit = top >= 0
        out[hit] = self.here[self.order][top[hit]]
        left = np.flatnonzero(~hit)
        if not len(left):
            return out
        g = grams[left]
        # the longest context the trie has, and the cost of escaping from it
        best = np.full(len(left), -1)
        at = np.zeros(len(left), np.int64)
        for j in range(self.order, -1, -1):
            open_ = np.flatnonzero(best < 0)
            if not len(open_):
                break
            c = self.contexts[j].find((g[open_] >> U(8)) & U((1 << (8 * j)) - 1))
            best[open_[c >= 0]] = j
            at[open_[c >= 0]] = c[c >= 0]
        cost = np.zeros(len(left))
        done = best < 0
        cost[done] = -np.log10(SYMBOLS)  # an empty trie
        # at level j: places whose n-gram is here are settled, the others go on to j - 1
        above = np.full(len(left), -1, np.int64)  # the context one level up, if the place came from there
        for j in range(self.order, -1, -1):
            arrived = np.flatnonzero(~done & (best >= j))
            if not len(arrived):
                continue
            fresh = best[arrived] == j
            context = np.where(fresh, at[arrived], -1)
            old = arrived[~fresh]
            if len(old):
                context[~fresh] = self.contexts[j].find((g[old] >> U(8)) & U((1 << (8 * j)) - 1))
            node = self.nodes[j].find(g[arrived] & U((1 << (8 * (j + 1))) - 1))
            found = node >= 0
            x = arrived[found & fresh]
            cost[x] += self.here[j][node[found & fresh]]
            x = arrived[found & ~fresh]
            if len(x):
                cost[x] += self.count[j][node[found & ~fresh]] - self.rest[j + 1][above[x]]
            done[arrived[found]] = True
            go = arrived[~found]
            first = fresh[~found]
            cost[go[first]] += self.escape[j][context[~found][first]]
            if j < self.order:
                rest = go[~first]
                # the escape from this level, with the symbols of the level above excluded
                cost[rest] += self.step[j + 1][above[rest]]
            above[go] = context[~found]
            if j == 0:
                cost[go] += self.uniform
        out[left] = cost
        return out


def trained(counts: DataFrame, order: int, max_nodes: int, scratch: Scratch) -> Trie:
    """A trie in one piece of at most ``max_nodes`` n-grams from summed (key, n) of order + 1 bytes; scores() has no such bound."""
    # each order's counts are sums of the next one's
    levels = [counts.withColumn("level", F.lit(order))]
    for j in range(order - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * (j + 1))) - 1))
        levels.append(scratch.save(levels[-1].groupBy(key.alias("key")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(j))))
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    bucket = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16))
    sizes = nodes.groupBy("level", bucket.alias("b")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()  # some 1,000 rows an order
    # low orders stay whole up to a quarter of the room; above them one smallest count holds for all
    whole, room = -1, max_nodes
    for j in range(order + 1):
        m = sum(r["m"] for r in sizes if r["level"] == j)
        if max_nodes - room + m > max_nodes // 4:
            break
        whole, room = j, room - m
    least = None
    above = sorted((r for r in sizes if r["level"] > whole), key=lambda r: -r["least"])
    for i, r in enumerate(above):
        room -= r["m"]
        if room < 0:
            break
        if i + 1 == len(above) or above[i + 1]["b"] != r["b"]:
            least = r["b"]
    kept = nodes.where((F.col("level") <= whole) | (bucket >= (least if least is not None else 1 << 40)))
    found = kept.select("level", "key", "n").toArrow()
    level, key, n = (found[c].to_numpy() for c in ("level", "key", "n"))
    return Trie([(k.view(np.uint64)[o], c[o]) for k, c, o in ((key[level == j], n[level == j], np.argsort(key[level == j])) for j in range(order + 1))])


def planes(values: np.ndarray) -> bytes:
    """Values by planes of bytes, which compress well where neighbours are near."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def packed(values: np.ndarray) -> bytes:
    """Values, compressed."""
    raw = planes(values)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpacked(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def coded(values: np.ndarray) -> bytes:
    """packed() for values of which many are equal: the distinct ones and their numbers, small for frequent values."""
    distinct, number, times = np.unique(values, return_inverse=True, return_counts=True)
    by = np.argsort(-times, kind="stable")
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    table = packed(distinct[by])
    return len(table).to_bytes(8, "little") + table + packed(rank[number])


def decoded(data: bytes, kind: type = np.float64) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return unpacked(data[8 : 8 + size], kind)[unpacked(data[8 + size :], np.uint32)]


#: Bytes of text that a task gathers, by home, before it sends them.
GATHER_BYTES = 1 << 23
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("scored", pa.bool_()), ("trains", pa.bool_())])


def gathered(texts: DataFrame) -> DataFrame:
    """(home, texts) of texts(home, doc_id, text, scored, trains): rows of a home in compressed blocks."""
    schema = pa.schema([("home", pa.int32()), ("texts", pa.binary())])

    def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("home").combine_chunks()
        homes = rows.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1]]))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(homes)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(lo, hi - lo).drop_columns("home").cast(TEXTS))
            yield batch(schema, [int(homes[lo])], [sink.getvalue().to_pybytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rb in batches:
            if rb.num_rows:
                held.append(rb)
                size += rb.nbytes
            if size > GATHER_BYTES:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return texts.select("home", "doc_id", "text", "scored", "trains").mapInArrow(lean(run), "home int, texts binary")


def rows_of(block: bytes) -> pa.RecordBatch:
    """(doc_id, text, scored, trains) of one of the blocks."""
    return pa.ipc.open_stream(block).read_all().combine_chunks().to_batches()[0]


def shorter(grams: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of n bytes that longer ones end with, and their counts."""
    return merged([(grams & U((1 << (8 * n)) - 1), counts)])


def part_of(grams: np.ndarray, split: int, parts: int) -> np.ndarray:
    return (t.mix64((grams >> U(8)) & U((1 << (8 * split)) - 1)) % U(parts)).astype(np.int32)


def trie_order(grams: np.ndarray) -> np.ndarray:
    """Keys that sort n-grams by their contexts, nearest byte first, and then by symbol: those of a part, which share near bytes, lie close."""
    return (grams >> U(8)).byteswap() | (grams & U(255))


def sent(texts: DataFrame, order: int, split: int, parts: int) -> DataFrame:
    """(part, home, grams, counts) of gathered() texts: the distinct n-grams of a home that fall to a part, and how often training texts have them."""
    schema = pa.schema([("part", pa.int32()), ("home", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def send(home: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams, counts = merged(held)
        part = part_of(grams, split, parts)
        by = np.lexsort((trie_order(grams), part))
        grams, counts = grams[by], counts[by]
        there, first = np.unique(part[by], return_index=True)
        ends = np.append(first[1:], len(grams))
        for i in range(0, len(there), 64):
            x = range(i, min(i + 64, len(there)))
            yield batch(schema, there[i : i + 64], np.full(len(x), home, np.int32), [packed(grams[first[k] : ends[k]]) for k in x], [packed(counts[first[k] : ends[k]]) for k in x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for rb in batches:
            for home, block in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                if home != at and own:
                    yield from send(at, own)
                    own = []
                at, rows = home, rows_of(block.as_py())
                for learn in (True, False):
                    chosen = rows.column(3) if learn else pc.invert(rows.column(3))
                    for _, _, grams, _, _ in streams(rows.column(1).filter(chosen), order):
                        keys, n = np.unique(grams, return_counts=True)
                        # a slice has fewer than 2**31 places
                        own.append((keys, n.astype(np.int32) if learn else np.zeros(len(keys), np.int32)))
                if sum(len(k) for k, _ in own) > 3_000_000:
                    own = [merged(own)]
                    if len(own[0][0]) > 2_000_000:
                        yield from send(at, own)
                        own = []
        if own:
            yield from send(at, own)

    return texts.mapInArrow(lean(run), "part int, home int, grams binary, counts binary")


def answered(blocks: DataFrame, low: list[tuple[np.ndarray, np.ndarray]], order: int, split: int) -> DataFrame:
    """(home, grams, costs) for each of the blocks, which lie together and in order by part; low has the levels under split."""
    schema = pa.schema([("home", pa.int32()), ("grams", pa.binary()), ("costs", pa.binary())])
    low = blocks.sparkSession.sparkContext.broadcast(low)

    def answer(held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        grams, counts = merged([(unpacked(g), unpacked(n, np.int64)) for _, g, n in held])
        # all n-grams that end like those of a part are in the part, so their sums are the shorter ones' counts
        levels = [(grams[counts > 0], counts[counts > 0])]
        for j in range(order - 1, split - 1, -1):
            levels.append(shorter(*levels[-1], j + 1))
        costs = Trie([*low.value, *levels[::-1]]).costs(grams)
        for i in range(0, len(held), 64):
            own = held[i : i + 64]
            yield batch(schema, [h for h, _, _ in own], [g for _, g, _ in own], [coded(costs[np.searchsorted(grams, unpacked(g))]) for _, g, _ in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for rb in batches:
            for part, *block in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if part != at and held:
                    yield from answer(held)
                    held = []
                at = part
                held.append(block)
        if held:
            yield from answer(held)

    return blocks.select("part", "home", "grams", "counts").mapInArrow(lean(run), "home int, grams binary, costs binary")


def scores(docs: DataFrame, train: DataFrame, order: int = 6, hot_words: int = 1 << 18) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text) under a model of train(text)."""
    docs = docs.select("doc_id", "text", F.lit(True).alias("scored"), F.lit(False).alias("trains"))
    return _scores(docs.unionByName(train.select(F.lit(None).alias("doc_id"), "text", F.lit(False).alias("scored"), F.lit(True).alias("trains"))), order, hot_words)


def _scores(texts: DataFrame, order: int, hot_words: int) -> DataFrame:
    """scores() of the rows of texts(doc_id, text, scored, trains) that are scored under a model of those that train."""
    spark, split = texts.sparkSession, min(SPLIT, order)
    scratch, sc = Scratch(spark), spark.sparkContext
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "scored", "trains")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // HOME_BYTES + 1)
    # with the task's number, as a row may be repeated in all of them
    texts = texts.withColumn("home", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int"))
    summed = scratch.save(corpus_counts(texts.where("trains"), max(split - 1, 0)).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = summed.where("kind = 1").select("key", "n")
    size = summed.where("kind > 0").agg(F.sum("n").alias("tokens"), F.count_if((F.col("kind") == 1) | (F.col("n") > 0)).alias("types"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).first()
    tokens, types, ends = (int(x or 0) for x in size)
    least = summed.where("kind = 0").select("key", "n").toArrow()
    low = [merged([(np.ascontiguousarray(least["key"].to_numpy()).view(np.uint64), least["n"].to_numpy())])]
    for j in range(split - 1, 0, -1):
        low.insert(0, shorter(*low[0], j))
    # texts are sent home once: both readers have the same exchange
    packs = gathered(texts).repartitionById(parts, F.col("home"))
    blocks = sent(packs.sortWithinPartitions("home"), order, split, parts)
    answers = answered(blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part"), low[:split], order, split)
    top = words.orderBy(F.desc("n"), "key").limit(hot_words).toArrow()
    hot = sc.broadcast((t.HashTable(np.ascontiguousarray(top["key"].to_numpy()).view(np.uint64)), top["n"].to_numpy()))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def rows(home: int, own: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        table, count = hot.value
        logs, end_log = np.log10(count + 0.5), np.log10(ends + 0.5)
        # an n-gram that was sent twice has the same cost twice
        model = t.HashTable(np.concatenate([unpacked(g.as_py()) for g in answers.column("grams")]))
        costs = np.concatenate([decoded(c.as_py()) for c in answers.column("costs")])
        row = home << 33
        for block in own.column("texts"):
            rb = rows_of(block.as_py())
            rb = rb.filter(rb.column(2))
            for lo, hi, grams, begins, (b, offsets) in streams(rb.column(1), order):
                n = hi - lo
                at = model.find(grams)
                if (at < 0).any():
                    raise ValueError("texts were not the same when they were read again")
                score = np.add.reduceat(costs[at], begins)
                starts, word_ends, first = t.words(b, offsets)
                h = t.word_hashes(b, starts, word_ends)
                at = table.find(h)
                there = at >= 0
                known = np.concatenate([[0], np.cumsum(there)])
                value = np.concatenate([[0.0], np.cumsum(np.where(there, logs[np.maximum(at, 0)] if len(logs) else 0.0, 0.0))])
                # the distinct other words of each text, and how often it has them
                doc, h = np.repeat(np.arange(n), np.diff(first))[~there], h[~there]
                by = np.lexsort((h, doc))
                doc, h = doc[by], h[by]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int64())) for v in (t.signed(h[new]), np.diff(np.append(new, len(h))))]
                tokens_here = np.diff(first)
                yield batch(schema, np.arange(row, row + n), rb.column(0).slice(lo, n), tokens_here + 1, known[first[1:]] - known[first[:-1]] + (ends > 0), value[first[1:]] - value[first[:-1]] + end_log, score, *lists)
                row += n

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        try:
            return pa.Table.from_batches(rows(key[0].as_py(), own, answers), schema)
        finally:
            given_back()

    at_home = packs.groupBy("home").cogroup(answers.repartitionById(parts, F.col("home")).groupBy("home"))
    found = scratch.save(at_home.applyInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"))
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    rare = rare.join(words, "key", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(n + 0.5)).alias("more_base"))
    out = found.drop("rare", "times").join(rare, "row", "left")
    norm = float(np.log10(tokens + 0.5 * (types + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


def held_out_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = 6, hot_words: int = 1 << 18) -> DataFrame:
    """scores() of docs(doc_id, text) under a model of all other folds, with held_out."""
    fold = F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False))
    out = _scores(docs.select("doc_id", "text", F.lit(True).alias("scored"), (~fold).alias("trains")), order, hot_words)
    return out.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
