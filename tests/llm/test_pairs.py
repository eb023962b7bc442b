"""N-gram join, repeated passages and decontamination against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import ngram_join as J
from vectide.llm import suffix_dedup as R
from vectide.llm.decontamination import Matcher, contamination, without_leaks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def components(documents, n, num, den):
    sets = []
    for i, x, *_ in documents:
        w = WORD.findall(lower(x))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if sets[a] and den * c >= num * len(sets[a] | sets[b]) and c:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k in range(len(sets)):
        least[root(k)].append(documents[k][0])
    return Counter((documents[k][0], len(sets[k]), documents[k][0] if not sets[k] else min((x for x in least[root(k)] if x is not None), default=None)) for k in range(len(sets)))


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_components(docs, documents, n, num, den):
    got = J.ngram_components(docs, n, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == components(documents, n, num, den)


def test_components_clashing_and_empty(clashing, empty, documents):
    got = J.ngram_components(clashing, 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == components(documents, 3, 90, 100)
    assert J.ngram_components(empty, 3, 90, 100).count() == 0
    assert J.one_of_each(empty).count() == 0


def test_blocks_give_the_same(docs, documents, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    got = J.ngram_components(docs, 2, 50, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == components(documents, 2, 50, 100)


def test_blocks_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    members = [(100 * g + i, g) for g, m in enumerate((1, 2, 3, 4, 5, 9, 16)) for i in range(m)]
    parts = defaultdict(list)
    for r in J.in_blocks(spark.createDataFrame(members, "id long, component long")).collect():
        parts[r["group"], r["part"]].append((r["class"], r["own"], r["inner"]))
    met = Counter()
    for own in parts.values():
        met.update(tuple(sorted((a, b))) for i, (a, x, inner) in enumerate(own) for b, y, _ in own[:i] if x != y or inner)
    assert met == Counter({(a, b): 1 for a, g in members for b, h in members if g == h and a < b})


def test_flood_gives_the_same(docs, documents, monkeypatch):
    monkeypatch.setattr(J, "MANY", 3)
    got = J.ngram_components(docs, 2, 50, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == components(documents, 2, 50, 100)


def test_one_of_each(clashing, documents):
    kept = J.one_of_each(clashing, 5, 80, 100)
    assert kept.columns == clashing.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    want = Counter()
    seen = set()
    for (i, n, c), m in components(documents, 5, 80, 100).items():
        if n == 0:
            want[i] += m
        elif c not in seen:
            seen.add(c)
            want[c] += 1
    assert got == want


def test_components_of_chain(spark):
    from vectide.llm._spark import Scratch, connected_components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


# --- repeated passages -----------------------------------------------------


def passages(documents, length):
    places = defaultdict(list)
    words = [WORD.findall(x or "") for _, x, *_ in documents]
    for d, w in enumerate(words):
        for k in range(len(w) - length + 1):
            places[tuple(w[k : k + length])].append((d, k))
    return words, places


def spans_of(starts, length):
    out = []
    for k in sorted(starts):
        if out and k <= out[-1][1]:
            out[-1][1] = max(out[-1][1], k + length)
        else:
            out.append([k, k + length])
    return out


@pytest.mark.parametrize("length", [5, 50])
def test_spans(docs, documents, length):
    _, places = passages(documents, length)
    starts = defaultdict(set)
    for p in places.values():
        if len(p) > 1:
            for d, k in p:
                starts[(documents[d][0], documents[d][1])].add(k)
    want = Counter((i, a, b, b - a) for (i, _), s in starts.items() for a, b in spans_of(s, length))
    assert Counter(map(tuple, R.repeated_spans(docs, length).collect())) == want


def test_hot_passages_give_the_same(docs):
    runs = [R.repeated_runs(R.keyed(docs.repartition(parts)), 5, hot=hot) for hot, parts in ((2, 1), (2, 7), (1 << 30, 3))]
    # which of all passages are repeated, and which of them go
    got = [Counter({(r["doc_id"], r["key"], k): r["removable"] for r in x.collect() for k in range(r["start"], r["end"] + 1)}) for x in runs]
    assert got[0] == got[1] == got[2] and len(got[0]) > 1000


def kept_texts(documents, keys, length):
    """The words that stay of every row, in the order of (id, key), where each passage stays at its first place."""
    seen, want = set(), []
    for r in sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, keys[r[0], r[1]])):
        w, gone = WORD.findall(r[1] or ""), set()
        for k in range(len(w) - length + 1):
            p = tuple(w[k : k + length])
            if p in seen:
                gone |= set(range(k, k + length))
            seen.add(p)
        want.append((r[0], tuple(x for k, x in enumerate(w) if k not in gone)))
    return Counter(want)


@pytest.mark.parametrize("length", [5, 20])
def test_without_repeats(spark, clashing, documents, length):
    wide = clashing.unionAll(clashing.where("doc_id in (5, 8, 20, 61) or doc_id is null")).unionAll(clashing.where("doc_id = 5"))
    out = R.without_repeats(wide, length)
    assert out.columns == clashing.columns
    all_rows = [(r["doc_id"], r["text"]) for r in wide.collect()]
    keys = {(r["doc_id"], r["text"]): r["key"] for r in R.keyed(wide).select("doc_id", "text", "key").collect()}
    got = out.collect()
    assert Counter((r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in got) == kept_texts(all_rows, keys, length)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert Counter(r["key"] for r in got) == {7: len(all_rows)}


def test_repeated_rows_keep_one_text(spark):
    text = "a b " + " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "c " + text), (None, "c " + text), (2, "short"), (2, "short"), (3, None), (3, None)], "doc_id long, text string")
    for parts in (1, 5):
        got = Counter(map(tuple, R.without_repeats(docs.repartition(parts)).collect()))
        assert got == Counter([(None, "c " + text), (None, ""), (1, ""), (1, ""), (2, "short"), (2, "short"), (3, None), (3, None)])


def test_neighbours_alone_would_not_do(spark):
    """The copy that goes on longest to the right isn't the one that goes on to the left."""
    left, mid, right = (" ".join(f"{x}{k}" for k in range(30)) for x in "lmr")
    docs = spark.createDataFrame([(1, f"{left} {mid} {right}"), (2, f"x {mid} {right} y"), (3, f"{left} {mid} z"), (4, f"{mid} {right} q")], "doc_id long, text string")
    got = sorted(map(tuple, R.repeated_spans(docs).collect()))
    assert got == [(1, 0, 90, 90), (2, 1, 61, 60), (3, 0, 60, 60), (4, 0, 60, 60)]


def test_without_repeats_keeps_bytes(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"head  {shared}\n tail"), (2, f"\tother\n{shared}  end "), (3, shared), (4, f"clean  text\n\n")], "doc_id long, text string")
    got = dict(map(tuple, R.without_repeats(docs).collect()))
    assert got == {1: f"head  {shared}\n tail", 2: "\tother  end ", 3: "", 4: "clean  text\n\n"}


def test_spans_of_empty(empty):
    assert R.repeated_spans(empty).count() == 0
    assert R.without_repeats(empty).count() == 0


# --- decontamination ---------------------------------------------------------


def edits(pattern, text):
    """The fewest edits from the pattern to any part of the text."""
    d = list(range(len(pattern) + 1))
    best = d[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(d[i - 1] + (p != c), d[i] + 1, new[i - 1] + 1))
        d = new
        best = min(best, d[-1])
    return best


def norm(x):
    return re.sub(r"\s+", " ", (x or "").lower()).strip(" ")


def windows_of(item, window):
    """The windows of a normalised item: every quarter of a window, and the last."""
    last = max(0, len(item) - window)
    return [item[a : a + window] for a in sorted({*range(0, last + 1, max(1, window // 4)), last})] if item else []


def leaks(texts, items, rate, window):
    """{(doc_id, item_id): fewest edits of a window that the text holds} by brute force."""
    want = {}
    for i, x in texts:
        for j, p in items:
            # the text is not stripped: a window may begin or end with a space
            found = [e for w in windows_of(norm(p), window) if (e := edits(w, re.sub(r"\s+", " ", (x or "").lower()))) <= min(int(len(w) * rate), len(w) - 1)]
            if found:
                want[i, j] = min(found)
    return want


def test_leaks(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghij klmno")
    make = lambda n: "".join(rng.choice(letters, n)).strip()
    items = [(k, make(int(rng.integers(22, 110)))) for k in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, "a tiny item z"), (94, " \n"), (95, make(31)), (96, make(9)), (97, make(17))]
    texts = []
    for k in range(60):
        item = items[[*range(12), 15, 17, 18, 19][k % 16]][1]
        noisy = list(item)
        for _ in range(k // 8):  # 0 to 7 edits
            at = int(rng.integers(len(noisy)))
            noisy[at : at + 1] = [[], ["x"], [noisy[at], "y"]][int(rng.integers(3))] if len(noisy) > 1 else ["x"]
        texts.append((k, make(100) + " " + "".join(noisy).upper() + "\n\t" + make(50)))
    texts += [(200, None), (201, ""), (None, items[0][1]), (202, make(2000)), (203, items[1][1]), (204, "tiny"), (205, items[19][1]), (206, items[19][1][1:])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in contamination(docs, bench, q=6, rate=0.1, window=64).collect()}
    want = leaks(texts, items, 0.1, 64)
    assert got == want and len({j for _, j in want}) > 12
    left = Counter(r["doc_id"] for r in without_leaks(docs, bench, q=6, rate=0.1, window=64).collect())
    assert left == Counter(i for i, _ in texts if not any(k == i for k, _ in want))


def test_leaks_do_not_cross_texts(spark):
    item = "an item of the benchmark whose halves stand in two texts"
    halves = [(1, "some words before " + item[:28]), (2, item[28:] + " some words after"), (3, item[:28]), (4, item[28:]), (5, item[:20]), (6, ""), (7, item[20:])]
    whole = [(8, item), (9, "x"), (10, item), (11, item + " " + item)]
    bench = spark.createDataFrame([(1, item), (2, "ab")], "item_id long, text string")
    tiny = [(20 + k, x) for k, x in enumerate(["a", "b", "ab", "ba", "a", "b"])]
    results = []
    for parts in (1, 4):
        docs = spark.createDataFrame(halves + whole + tiny, "doc_id long, text string").repartition(parts) if parts > 1 else spark.createDataFrame(halves + whole + tiny, "doc_id long, text string").coalesce(1)
        results.append(sorted((r["doc_id"], r["item_id"], r["edits"], r["place"]) for r in contamination(docs, bench).collect()))
        assert {r["doc_id"] for r in without_leaks(docs, bench).collect()} == {x for x, *_ in halves + whole + tiny} - {8, 10, 11, 22}
    assert results[0] == results[1] == [(8, 1, 0, 0), (10, 1, 0, 0), (11, 1, 0, 0), (22, 2, 0, 0)]


def test_excerpts_of_an_item(spark):
    rng = np.random.default_rng(9)
    item = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9)))) for _ in range(60))
    docs = spark.createDataFrame([(a, "before it " + item[a : a + 79] + " after") for a in range(0, len(item) - 79, 7)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert contamination(docs, bench).count() == docs.count() and without_leaks(docs, bench).count() == 0


def test_leaks_clashing(clashing, spark):
    text = clashing.where("doc_id = 5").first()["text"]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    wide = clashing.withColumns({"item_id": F.lit(3), "windows": F.lit("w"), "edits": F.lit(0), "place": F.lit(1)})
    left = without_leaks(wide, bench)
    assert left.columns == wide.columns and 5 not in {r["doc_id"] for r in left.collect()}
    assert {r["doc_id"] for r in contamination(wide, bench).collect()} >= {5} and left.count() < wide.count()


def test_blocks_of_the_benchmark(spark, docs, documents):
    bench = spark.createDataFrame([(k, x[40:160]) for k, (_, x, *_) in enumerate(documents) if x and len(x) > 200][:10], "item_id long, text string")
    whole = Counter(map(tuple, contamination(docs, bench).collect()))
    assert whole and whole == Counter(map(tuple, contamination(docs, bench, block_chars=300).collect()))
    left = Counter(r["doc_id"] for r in without_leaks(docs, bench).collect())
    assert left == Counter(r["doc_id"] for r in without_leaks(docs, bench, block_chars=300).collect())


def test_leaks_of_empty(empty, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).count() == 0
    assert without_leaks(docs, none).count() == docs.count()
    some = spark.createDataFrame([(1, "a passage that is long enough to be searched for")], "item_id long, text string")
    assert contamination(empty, some).count() == 0


def test_windows_of_an_item():
    text = "0123456789abcdefghij" * 12
    m = Matcher([(1, text)], 9, 0.08, 128)
    assert ["".join(map(chr, c)) for c in m.padded] == windows_of(text, 128) and m.total == {0: len(m.start)}
    # 3 edits in 30 characters leave no 8-gram for certain, so shorter ones are taken
    assert Matcher([(1, "x" * 30)], 8, 0.1, 64).q.tolist() == [7]
