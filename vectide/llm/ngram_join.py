"""N-gram Jaccard join and its components (operator 4).

Rare-first prefix filtering: the distinct word n-grams of a document are put in
one global order, rarest first, and only a short prefix of each set is joined.
Two sets that reach the threshold share an n-gram in their prefixes whatever the
order is, so the order only decides the cost. It has three tiers: a share of the
n-grams picked by hash, by their exact document frequency; the other n-grams, by
hash; and n-grams of hot buckets, by hash. The first tier is made large enough to
fill the prefix, so frequencies of the other n-grams are never needed. Its
n-grams of frequency 1 fill the first places of a prefix and join with nothing.
Sizes (length filter), places (positional filter) and the counts of 16 segments
of the hash space (a one-step suffix filter) rule out most of what meets on a
prefix n-gram; the rest is verified exactly.

Scale. Identical sets are one class from the first task on, and a task emits a
class once, so a group of copies costs a row per task. n-grams in over a
sixteenth of all documents are known by a table of 2**18 bucket counts (a fixed
2 MB, counted over all documents) and are not shuffled to be counted. Pairs are
formed inside a sorted stream of prefix n-grams and leave it as a spanning
forest, never as all pairs. Classes whose candidates hang together are verified
side by side, in pairs of blocks where a group is large; every pair is met in one
place only and left out if its classes are linked there already, as it then cannot
change a component. Evicting by the length filter bounds what a stream holds. n-grams
and sets are known by 64-bit hashes; two different sets of n documents collide
with a chance below n**2 / 2**65.

Edge cases: a document with fewer words than n has its whole sequence as one
n-gram; a null, empty or blank text has none and links with nothing (its
component is its own id). A row with a null doc_id takes part like any other;
its component is the smallest id it reaches, or null. Repeated rows are kept.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import _text as t
from vectide.llm._spark import Scratch, batch, connected_components, lean, released

BUCKETS = 1 << 18
#: Members of a block of classes that are compared in one task.
BLOCK = 1024
U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word n-grams) for every row."""
    for first, _, raw, offsets in t.slices(column):
        b = t.LOWER[raw]
        starts, ends, at = t.words(b, offsets)
        h = t.word_hashes(b, starts, ends)
        i = np.arange(max(0, len(h) - n + 1))
        grams = t.rolled(h, i, i + n, t.WORDS)
        for d in range(len(offsets) - 1):
            lo, hi = at[d], at[d + 1]
            if hi - lo >= n:
                yield first + d, np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield first + d, t.rolled(h[lo:hi], np.array([0]), np.array([hi - lo]), t.WORDS)
            else:
                yield first + d, h[:0]


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(s):
        return 0
    v = np.array([int(t.mix64(s).sum(dtype=np.uint64)) ^ len(s)], dtype=np.uint64)
    return int(t.mix64(v).view(np.int64)[0])


def min_overlap(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes reach num/den."""
    return -(-num * (na + nb) // (den + num))


def segments(s: np.ndarray) -> tuple[int, int]:
    """Members in each of 16 equal parts of the hash space, a byte each (255 at most)."""
    c = np.minimum(np.bincount((s >> U(60)).astype(np.int64), minlength=16), 255).astype(np.uint8)
    return tuple(c.view(np.int64).tolist())


def segment_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of |A xor B| from rows of 16 bytes."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1)


class Forest:
    """Union-find over arbitrary keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, y = self.up, x
        while (z := up.get(y, y)) != y:
            y = z
        while (z := up.get(x, x)) != y:
            up[x] = y
            x = z
        return y

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, class) of all docs(doc_id, text_key, text), and rows (bucket, df) with each task's document frequencies."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("bucket", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, known = np.zeros(BUCKETS, np.int64), set()
        for b in batches:
            size, name, fresh = [], [], []
            for _, s in shingle_sets(b.column(2), n):
                c = class_of(s)
                size.append(len(s))
                name.append(c)
                if c not in known:
                    known.add(c)
                    fresh.append(s)
            if fresh:
                df += np.bincount((np.concatenate(fresh) & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            yield batch(schema, b.column(0), b.column(1), size, name, pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.int64()))
        at = np.flatnonzero(df)
        none = pa.nulls(len(at), pa.int64())
        yield batch(schema, none, none, none, none, at.astype(np.int32), df[at])

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, class long, bucket int, df long")


def ordered(docs: DataFrame, n: int, num: int, den: int, hot) -> DataFrame:
    """What the prefix of every class is made of, once per task: three kinds of rows.

    (token, class): n-grams of the first tier; (token, class, place): n-grams of later tiers that
    the prefix reaches; (class, size, first, s0, s1): the class, with the size of its first tier.
    """
    schema = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("first", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64())])
    share = U(min(256, -(-448 * (den - num) // den)))  # of 256: one and three quarters of a prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot, known = hot.value, set()
        for b in batches:
            tokens, owners, places, infos = [], [], [], []
            for _, s in shingle_sets(b.column(0), n):
                m = len(s)
                if not m or (c := class_of(s)) in known:
                    continue
                known.add(c)
                p = m - -(-num * m // den) + 1
                common = is_hot[(s & U(BUCKETS - 1)).astype(np.int64)]
                picked = ((s * U(0xD1342543DE82EF95)) >> U(56) < share) & ~common
                first = s[picked]
                later = np.concatenate([s[~picked & ~common], s[common]])[: max(0, p - len(first))]
                tokens += [first, later]
                owners.append(np.full(len(first) + len(later), c, np.int64))
                places += [np.full(len(first), -1, np.int32), np.arange(len(first), len(first) + len(later), dtype=np.int32)]
                infos.append((c, m, len(first), *segments(s)))
            if infos:
                flat, owner, place = t.signed(np.concatenate(tokens)), np.concatenate(owners), np.concatenate(places)
                none = [pa.nulls(len(flat), k) for k in schema.types[3:]]
                yield batch(schema, flat, owner, pa.array(place, mask=place < 0), *none)
                c, m, f, s0, s1 = zip(*infos, strict=True)
                yield batch(schema, pa.nulls(len(c), pa.int64()), c, pa.nulls(len(c), pa.int32()), m, f, s0, s1)

    return docs.select("text").mapInArrow(lean(run), "token long, class long, place int, size int, first int, s0 long, s1 long")


#: Frequencies are counted up to here; a stream of one n-gram holds no more rows.
MANY = 100_000


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(class, token, df) of tokens(token, class) that several classes have; df is MANY at most."""
    schema = pa.schema([("class", pa.int64()), ("token", pa.int64()), ("df", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, owner, flood = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def emit(token: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(token):
                df = np.searchsorted(token, token, "right") - np.searchsorted(token, token, "left")
                keep = df > 1
                if keep.any():
                    yield batch(schema, owner[keep], token[keep], np.minimum(df[keep], MANY).astype(np.int32))

        for rb in batches:
            x, c = (v.to_numpy(zero_copy_only=False) for v in rb.columns)
            if flood is not None:  # a token that is known to be in MANY classes streams through
                n = int(np.searchsorted(x, flood, "right"))
                if n:
                    yield batch(schema, c[:n], x[:n], np.full(n, MANY, np.int32))
                if n == len(x):
                    continue
                x, c, flood = x[n:], c[n:], None
            x, c = np.concatenate([token, x]), np.concatenate([owner, c])
            fresh = np.ones(len(x), bool)  # several tasks may have sent a class
            fresh[1:] = (x[1:] != x[:-1]) | (c[1:] != c[:-1])
            x, c = x[fresh], c[fresh]
            if not len(x):
                continue
            cut = int(np.searchsorted(x, x[-1], "left"))
            yield from emit(x[:cut], c[:cut])
            token, owner = x[cut:], c[cut:]
            if len(token) > MANY:
                flood = token[0]
                yield batch(schema, owner, token, np.full(len(token), MANY, np.int32))
                token, owner = token[:0], owner[:0]
        yield from emit(token, owner)

    return tokens.repartition("token").sortWithinPartitions("token", "class").mapInArrow(lean(run), "class long, token long, df int")


def prefix_postings(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(token, class, size, place, s0, s1): the prefix n-grams that may be shared, from ordered() rows."""
    infos = rows.where("token is null").select("class", "size", "first", "s0", "s1").dropDuplicates(["class"])
    infos = infos.withColumn("prefix", F.expr(f"cast(size - (({num}L * size + {den - 1}) div {den}) + 1 as int)"))
    shared = shared_tokens(rows.where("token is not null and place is null").select("token", "class"))
    # n-grams of frequency 1 come before those of several classes
    listed = shared.groupBy("class").agg(F.collect_set(F.struct("df", "token")).alias("t")).join(infos, "class")
    alone = F.col("first") - F.size("t")
    listed = listed.where(alone < F.col("prefix")).withColumn("alone", alone)
    first = listed.select("class", "size", "s0", "s1", "alone", F.posexplode(F.slice(F.array_sort("t"), F.lit(1), F.col("prefix") - F.col("alone"))).alias("i", "x"))
    first = first.select(F.col("x.token").alias("token"), "class", "size", (F.col("alone") + F.col("i")).alias("place"), "s0", "s1")
    later = rows.where("place is not null").select("token", "class", "place").join(infos, "class").select("token", "class", "size", "place", "s0", "s1")
    return first.unionAll(later)


def settled(token: np.ndarray, run_end: np.ndarray, name: np.ndarray, rows: np.ndarray, forest: Forest) -> np.ndarray:
    """Whether all classes in the run of each of these rows hang together already: more pairs of such a run add nothing.

    Asked at doubling distances, it keeps a large group of near copies from being compared pair by pair.
    """
    if not len(rows):
        return np.zeros(0, bool)
    starts, of_row = np.unique(np.searchsorted(token, token[rows], "left"), return_inverse=True)
    done = []
    for a, z in zip(starts.tolist(), run_end[starts].tolist(), strict=True):
        first = forest.root(int(name[a]))
        done.append(all(forest.root(x) == first for x in name[a + 1 : z].tolist()))
    return np.array(done)[of_row]


def candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest, in each task, of the class pairs that no filter rules out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, fresh = Forest(), None, 0
        for rb in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
            if held is not None:
                fresh = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            token, name, size, place, s0, s1 = cols
            if not len(token):
                continue
            run_end = np.searchsorted(token, token, "right")
            seg = np.ascontiguousarray(np.stack([s0, s1], axis=1)).view(np.uint8).reshape(-1, 16)
            act, lag, out = np.flatnonzero(run_end - np.arange(len(token)) > 1), 1, []
            while len(act):
                other = act + lag
                ok = other < run_end[act]
                act, other = act[ok], other[ok]
                ok = size[act].astype(np.int64) * den >= size[other].astype(np.int64) * num  # sizes ascend in a run
                act, other = act[ok], other[ok]
                na, nb = size[act].astype(np.int64), size[other].astype(np.int64)
                need = min_overlap(na, nb, num, den)
                keep = (other >= fresh) & (name[act] != name[other]) & (np.minimum(na - place[act], nb - place[other]) >= need)
                x, y, slack = act[keep], other[keep], (na + nb - 2 * need)[keep]
                keep = segment_gap(seg[x], seg[y]) <= slack
                out += [(a, b) for a, b in zip(name[x[keep]].tolist(), name[y[keep]].tolist(), strict=True) if forest.join(a, b)]
                lag += 1
                if lag & (lag - 1) == 0 and lag > 8:
                    act = act[~settled(token, run_end, name, act, forest)]
            if out:
                yield batch(schema, *zip(*out, strict=True))
            # the last run may go on in the next batch; members too small for the largest so far can't link any more
            tail = np.flatnonzero((token == token[-1]) & (size.astype(np.int64) * den >= int(size[-1]) * num))
            held = [c[tail] for c in cols]

    return postings.repartition("token").sortWithinPartitions("token", "size", "class").mapInArrow(lean(run), "a long, b long").distinct()


def class_sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """(class, size, members) of the classes that may be wanted, once per task. ``wanted``: words of a bit filter over class names."""
    schema = pa.schema([("class", pa.int64()), ("size", pa.int32()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = wanted.value, set()
        for b in batches:
            out = []
            for _, s in shingle_sets(b.column(0), n):
                c = class_of(s)
                slot = c & (FILTER_BITS - 1)
                if len(s) and bits[slot >> 6] >> U(slot & 63) & U(1) and c not in known:
                    known.add(c)
                    out.append((c, len(s), s.tobytes()))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    return docs.select("text").mapInArrow(lean(run), "class long, size int, members binary")


#: Bits of the filter over candidate classes: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def class_filter(classes: DataFrame) -> np.ndarray:
    """A fixed-size bit filter over the class names; false positives only cost time."""
    slot = F.col("class").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = classes.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(class & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    found = words.toPandas()  # FILTER_BITS / 64 rows at most
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def verified(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect the classes of each group (group, part, own, inner, class, size, members) as all its links do.

    Pairs of two blocks are compared in their part, pairs within a block only where it is ``inner``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(names: np.ndarray, sizes: np.ndarray, own: np.ndarray, inner: np.ndarray, blobs: list[bytes]) -> list[tuple[int, int]]:
        tokens = np.frombuffer(b"".join(blobs), np.uint64)
        _, ids = np.unique(tokens, return_inverse=True)
        ends = np.cumsum(sizes)
        begins, m = ends - sizes, len(names)
        seg = np.array([segments(np.frombuffer(x, np.uint64)) for x in blobs], dtype=np.int64).view(np.uint8).reshape(-1, 16)
        mark, label, out = np.zeros(int(ids.max()) + 1, bool), np.arange(m), []
        for i in range(m - 1):
            js = np.arange(i + 1, m)
            js = js[(sizes[js] * num <= sizes[i] * den) & (label[js] != label[i]) & (inner[i] | (own[js] != own[i]))]
            if not len(js):
                continue
            need = min_overlap(sizes[i], sizes[js], num, den)
            ok = segment_gap(seg[js], seg[i][None, :]) <= sizes[i] + sizes[js] - 2 * need
            js, need = js[ok], need[ok]
            if not len(js):
                continue
            mark[ids[begins[i] : ends[i]]] = True
            step = 16
            while len(js):  # the first links often settle the others
                now = js[:step]
                flat = np.concatenate([ids[begins[j] : ends[j]] for j in now])
                cuts = np.cumsum(sizes[now]) - sizes[now]
                for j in now[np.add.reduceat(mark[flat].astype(np.int64), cuts) >= need[:step]]:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        out.append((int(names[i]), int(names[j])))
                js, need = js[step:], need[step:]
                open_ = label[js] != label[i]
                js, need = js[open_], need[open_]
                step *= 2
            mark[ids[begins[i] : ends[i]]] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sizes, own, inner, blobs = None, [], [], [], [], []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(names) > 1:
                out.extend(links(np.array(names), np.array(sizes, np.int64), np.array(own), np.array(inner), blobs))
            for x in (names, sizes, own, inner, blobs):
                x.clear()

        for rb in batches:
            for g, p, o, within, c, s, m in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if (g, p) != key:
                    flush()
                    key = (g, p)
                if not names or names[-1] != c:
                    names.append(c)
                    sizes.append(s)
                    own.append(o)
                    inner.append(within)
                    blobs.append(m)
            if out:
                yield batch(schema, *zip(*out, strict=True))
                out.clear()
        flush()
        if out:
            yield batch(schema, *zip(*out, strict=True))

    columns = groups.select("group", "part", "own", "inner", "class", "size", "members")
    return columns.repartition("group", "part").sortWithinPartitions("group", "part", "size", "class").mapInArrow(lean(run), "a long, b long")


def in_blocks(members: DataFrame) -> DataFrame:
    """(class, group, part, own, inner): members(id, component) of candidate groups, dealt to all pairs of blocks where a group has over BLOCK members.

    own is the class's block. Its pairs within the block are compared in one part, with the next block, where inner is true.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    out = members.join(sizes, "component").withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    # a pair of blocks (x, y), x < y, is part x * k + y; the last block's next one is the first
    other = F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    out = out.withColumn("other", F.explode(other)).where("k = 1 or own <> other")
    part = F.least("own", "other") * F.col("k") + F.greatest("own", "other")
    inner = F.col("other") == (F.col("own") + 1) % F.col("k")
    return out.select(F.col("id").alias("class"), F.col("component").alias("group"), part.alias("part"), "own", inner.alias("inner"))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, component_id) of every row of docs(doc_id, text); sets link when den * |A and B| >= num * |A or B|."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = scratch.save(survey(docs, n))
    counts = found.where("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # BUCKETS rows at most
    df = np.zeros(BUCKETS, np.int64)
    df[counts["bucket"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    rows = found.where("bucket is null").select("doc_id", "text_key", "n_shingles", "class")
    hot = spark.sparkContext.broadcast(df > max(256, rows.count() // 16))
    parts = scratch.save(ordered(docs, n, num, den, hot))
    edges = scratch.save(candidates(prefix_postings(parts, num, den), num, den))
    scratch.drop(parts)
    groups = connected_components(edges, scratch)
    sets = class_sets(docs, n, spark.sparkContext.broadcast(class_filter(groups.select(F.col("id").alias("class")))))
    links = scratch.save(verified(sets.join(in_blocks(groups), "class"), num, den))
    label = connected_components(links, scratch).select(F.col("id").alias("class"), "component")
    # a class without links is its own component; documents without n-grams stay alone
    least = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(label, "class", "left")
    named = least.select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.join(smallest, "component").select("class", "component_id")
    full = rows.where("n_shingles > 0").join(names, "class").select("doc_id", "text_key", "n_shingles", "class", "component_id")
    return full.unionAll(rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", "class", F.col("doc_id").alias("component_id")))


def decided(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of the documents that go, and of those that stay but have repeated rows."""
    work = Scratch(docs.sparkSession)
    rows = ngram_components(docs, n, num, den, work).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    # the class of the component's smallest id names it, also where that id is null
    kept = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("class")).alias("c")).agg(F.min(order).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_key").alias("kept_key"))
    copies = rows.groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("again"))
    of = copies.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left")
    found = scratch.save(of.where("kept_key is null or again").select("doc_id", "text_key", F.col("kept_key").isNull().alias("goes")))
    work.drop()
    return found.where("goes").drop("goes"), found.where("not goes").drop("goes")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, that stay when of every component only one row does.

    It is the row with the smallest doc_id (null last), of those the one with the smallest hash of
    its text; documents without n-grams all stay.
    """
    gone, again = decided(docs, n, num, den, Scratch(docs.sparkSession))
    released(docs.sparkSession)
    # by one way at every size: texts are shuffled once, and what goes is not broadcast where it happens to be small
    gone, again = gone.toDF("gone_id", "gone_key").hint("merge"), again.toDF("again_id", "again_key")
    # the row as it came is one column, so its names can't clash with those in use here
    keyed = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    # repeated rows of a kept document: one stays
    if again.isEmpty():
        return left.select("whole.*")
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_key") == F.col("again_key"))
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.join(again, same, "left_anti").unionAll(once).select("whole.*")
