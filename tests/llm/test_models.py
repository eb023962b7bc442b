"""Language models, classifiers, codecs and scans: against brute force, libraries or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LANGS, SCHEMA, rows, text_of
from vectide.llm import language_id, license_scan, ppm, quality_rules, rule_ensemble
from vectide.llm import sentencepiece_codec as codec
from vectide.llm import token_counts as counts

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def fold(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def as_rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- text primitives ----------------------------------------------------------


def test_hash_table():
    from vectide.llm._text import HashTable, mix64

    keys = np.unique(np.append(mix64(np.arange(1, 5000, dtype=np.uint64)), np.array([0], np.uint64)))
    table = HashTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(mix64(np.arange(10_000, 20_000, dtype=np.uint64))) == -1).all()
    assert (HashTable(keys[:0]).find(keys[:3]) == -1).all()


def test_words_of_a_slice():
    from vectide.llm import _text as t

    texts = ["The cat", None, "", " x\ty ", "cat", "é\n"]
    b, o = t.utf8(pa.array(texts))
    s, e, first = t.words(b, o)
    assert [bytes(b[i:j]).decode() for i, j in zip(s, e)] == ["The", "cat", "x", "y", "cat", "é"]
    assert first.tolist() == [0, 2, 2, 2, 4, 5, 6]
    h = t.word_hashes(b, s, e)
    assert h[1] == h[4] == t.hash_strings(["cat"])[0] and len(set(h.tolist())) == 5


# --- operator 2 ------------------------------------------------------------------


def brute_ppm(levels, order, context, s):
    excluded, cost = set(), 0.0
    for j in range(order, -1, -1):
        c = tuple(context[len(context) - j :]) if j else ()
        kids = {k[-1]: n for k, n in levels[j].items() if k[:-1] == c}
        if not kids:
            continue
        free = {x: n for x, n in kids.items() if x not in excluded}
        if free:
            total = sum(free.values()) + len(free)
            if s in free:
                return cost + math.log10(free[s] / total)
            cost += math.log10(len(free) / total)
        excluded |= set(kids)
    return cost - math.log10(max(1, ppm.SYMBOLS - len(excluded)))


def test_ppm_scores(spark):
    order, texts = 3, ["the cat sat on the mat. The cat", "abracadabra", "banana bandana é", "", None, "the dog zzz", "xyz\nxyz"]
    train = texts[:5]
    seq = lambda x: [ppm.START] * order + list(lower(x).encode()) + [ppm.END]
    levels = [Counter() for _ in range(order + 1)]
    for x in train:
        s = seq(x)
        for i in range(order, len(s)):
            for j in range(order + 1):
                levels[j][tuple(s[i - j : i + 1])] += 1
    words = Counter(w for x in train for w in WORD.findall(lower(x)))
    n, v = sum(words.values()) + len(train), len(words) + 1
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    made = spark.createDataFrame([(x,) for x in train], "text string")
    for hot in (1 << 18, 3):
        got = {r["doc_id"]: r for r in ppm.scores(docs, made, order=order, hot_words=hot).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(texts):
            s, w = seq(x), WORD.findall(lower(x))
            assert got[i]["score"] == pytest.approx(sum(brute_ppm(levels, order, s[:k], s[k]) for k in range(order, len(s))))
            base = sum(math.log10((words[y] + 0.5) / (n + 0.5 * (v + 1))) for y in w) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
            assert got[i]["base_score"] == pytest.approx(base)
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w) + 1, sum(y in words for y in w) + 1, n)


def test_ppm_sums_to_one(spark):
    texts = ["the cat sat on the mat", "the hat"]
    train = spark.createDataFrame([(x,) for x in texts], "text string")
    for room in (1 << 20, 40):
        from vectide.llm._spark import Scratch

        c = ppm.corpus_counts(train, 2).groupBy("kind", "key").sum("n").withColumnRenamed("sum(n)", "n")
        trie = ppm.trained(c.where("kind = 0").select("key", "n"), 2, room, Scratch(spark))
        for context in (b"th", b"zz", b"t "):
            high = context[0] << 16 | context[1] << 8
            p = trie.costs(np.array([high | x for x in range(256) if x != ppm.START], np.uint64))
            assert 10**p @ np.ones(len(p)) == pytest.approx(1.0, abs=1e-9)


def test_ppm_is_whole(spark, monkeypatch):
    """More n-grams than 2**20, dealt out to many homes and parts, give the scores of one trie of all of them."""
    monkeypatch.setattr(ppm, "HOME_BYTES", 1 << 16, raising=False)
    rng, order = np.random.default_rng(3), 5
    texts = [bytes(rng.integers(97, 123, 25_000, dtype=np.uint8)).decode() for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.scores(docs, docs.where("doc_id < 20"), order=order).collect()}
    grams = lambda x: next(ppm.streams(pa.array(x), order, 1 << 30))[2]
    learned = grams(texts[:20])
    levels = [np.unique(learned & np.uint64((1 << (8 * (j + 1))) - 1), return_counts=True) for j in range(order + 1)]
    assert sum(len(k) for k, _ in levels) > 1 << 20
    trie = ppm.Trie(levels)
    for i, x in enumerate(texts):
        assert got[i] == pytest.approx(trie.costs(grams([x])).sum())


def test_ppm_learns_six_bytes(spark):
    """Only contexts of six bytes tell what follows: q after 1abcde, z after 2abcde."""
    train = spark.createDataFrame([("1abcdeq2abcdez" * 200,)], "text string")
    docs = spark.createDataFrame([(0, "1abcdeq2abcdez" * 50)], "doc_id long, text string")
    assert ppm.scores(docs, train).first()["score"] > -10


def test_ppm_edges(docs, clashing, empty, documents):
    got = ppm.held_out_scores(clashing, order=3)
    assert as_rows(got, "doc_id", "held_out") == Counter((i, fold(i, 5) == 1) for i, *_ in documents)
    assert ppm.held_out_scores(empty).count() == 0
    none = ppm.scores(docs, empty, order=2).collect()
    assert len(none) == len(documents) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


# --- operators 3 and 9 ---------------------------------------------------------


@pytest.fixture(scope="module")
def graded(spark):
    """Documents of which those with odd ids are junk, and their labels."""
    rng, data, labels = random.Random(7), [], []
    for i in range(400):
        x = text_of(rng, "en", rng.randint(60, 120))
        if i % 2:
            kind = i % 6
            x = " ".join(w + "###" for w in x.split()) if kind == 1 else (x.upper().replace(" ", "!! ") if kind == 3 else " ".join([x.split()[0]] * 80))
        data.append((i, x, "en", "s", len(x)))
        if i % 3:
            labels.append((i, 1 - i % 2, 0))
    data += [(1000, None, "en", "s", None), (1001, "", "en", "s", 0), (None, data[0][1], "en", "s", 1)]
    labels += [(5000, 1, 0), (None, 0, 0), (0, None, None), (3, 0, 0)]
    return spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), data


def base_of(x):
    w = WORD.findall(x or "")
    seen, dup = set(), 0
    for line in (x or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for j in range(len(w) - 2):
        if c[tuple(w[j : j + 3])] > 1:
            hit |= {j, j + 1, j + 2}
    return len(w), sum(map(len, w)), sum(map((x or "").count, "#*$%&|<>")), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(docs, documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels)
    assert as_rows(got, "doc_id", *NAMES) == Counter((i, *base_of(x)) for i, x, *_ in documents)
    for r in got.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no labels: nothing else fails


def test_quality_rules(graded):
    docs, labels, data = graded
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels, sample=200).collect()}
    right = [got[i]["kept"] == (i % 2 == 0) for i, *_ in data if i is not None and i < 1000]
    assert np.mean(right) > 0.98
    assert not got[1000]["kept"] and not got[1001]["kept"] and got[None]["kept"]


def test_quality_rules_fit_on_4000_rows(spark, tmp_path, monkeypatch):
    from vectide.llm import queries

    spark.range(4200).selectExpr("id AS doc_id", "'some words' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(4200).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    taken, fit = [], quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda texts, labels: (taken.append(len(texts)), fit(texts[:20], labels[:20]))[1])
    queries.op9_quality_rules(spark, str(tmp_path))
    assert taken == [4000]


def test_rule_ensemble(graded):
    docs, labels, data = graded
    out = rule_ensemble.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i, *_ in data if i is not None and i < 1000 and fold(i, 4) == 2]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) >= len(held)
    assert np.mean([got[i]["predicted"] == 1 - i % 2 for i in held]) > 0.95
    assert not any(re.search("Python", x) and "MapInArrow" not in x for x in out._jdf.queryExecution().toString().split("\n") if "BatchEvalPython" in x)


def test_rules_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rule_ensemble.quality_scores(docs, none).collect()} == {0.5}
    assert rule_ensemble.quality_scores(empty, none).count() == 0
    assert quality_rules.quality_rules(empty, none).count() == 0


def test_compiled_rules_agree(spark):
    """The compiled expression gives what the rules give one by one."""
    rng = np.random.default_rng(0)
    x = rng.random((500, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(int)
    rules, bias = model = rule_ensemble.fit(x, y)
    p = [1 / (1 + math.exp(-(bias + sum(w for r, w in rules if all((row[f] > cut) == greater for f, greater, cut in r))))) for row in x]
    assert rules and np.mean((np.array(p) > 0.5) == y) > 0.97
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i long, " + ", ".join(f"{n} double" for n in rule_ensemble.STATISTICS))
    got = {r["i"]: r["p"] for r in frame.select("i", rule_ensemble.compiled(model).alias("p")).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(p, abs=1e-12)


def test_rules_are_paths_of_trees():
    """Every rule is a conjunction along a path, and one split finds the best cut by brute force."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((60, 2)), 2)
    y = (x[:, 1] > 0.37).astype(float)
    rules = rule_ensemble.tree_rules(x, y, trees=1, depth=1)
    assert len(rules) == 2
    (f, greater, cut), (f2, greater2, cut2) = rules[0][0], rules[1][0]
    assert f == f2 == 1 and cut == cut2 and greater != greater2
    g, h = y.mean() - y, np.full(60, y.mean() * (1 - y.mean()))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = [score(x[:, k] <= c) + score(x[:, k] > c) for k in range(2) for c in np.unique(x[:, k])[:-1]]
    assert score(x[:, 1] <= cut) + score(x[:, 1] > cut) == pytest.approx(max(gains))
    deep = rule_ensemble.tree_rules(x, y, trees=3, depth=3)
    assert all(1 <= len(r) <= 3 for r in deep) and {r[:-1] for r in deep if len(r) > 1} <= set(deep)


def brute_statistics(text):
    x = text or ""
    w, raw = WORD.findall(x), x.encode()
    full = [line for line in x.split("\n") if WORD.search(line)]
    size = sum(len(v.encode()) for v in w)
    upper = sum(65 <= c < 91 for c in raw)
    letters = upper + sum(97 <= c < 123 or c >= 128 for c in raw)
    grams = Counter(zip(w, w[1:], w[2:]))
    per = lambda a, n: a / max(1, n)
    return [
        math.log1p(len(w)),
        per(size, len(w)),
        per(sum(len(v.encode()) > 12 for v in w), len(w)),
        per(sum(c in b"#*$%&|<>" for c in raw), size),
        per(upper, letters),
        per(sum(48 <= c < 58 for c in raw), size),
        per(sum(c in b".,;:!?'\"()[]{}-_/\\@^~`+=" for c in raw), size),
        per(raw.count(b"!"), len(w)),
        per(sum(c >= 128 for c in raw), size),
        1 - per(len(w) - len(set(w)), len(w)),
        per(sum(n for n in grams.values() if n > 1), len(w)),
        per(len(full) - len(set(full)), len(full)),
        per(len(w), len(full)),
        per(sum(line[-1] in ".!?" for line in full), len(full)),
        per(sum("A" <= v[0] <= "Z" for v in w), len(w)),
    ]


def test_statistics(docs, documents):
    got = sorted(([r["doc_id"] or -1, *(r[n] for n in rule_ensemble.STATISTICS)] for r in rule_ensemble.with_statistics(docs).collect()))
    want = sorted([i or -1, *brute_statistics(x)] for i, x, *_ in documents)
    assert np.array(got) == pytest.approx(np.array(want), abs=1e-9)


def brute_margin(text, model):
    """A mean of the weights of each n-gram family, by slots worked out one by one."""
    from vectide.llm import _text as t

    raw, mask, out = (text or "").encode(), (1 << 64) - 1, model.bias
    for n in (3, 5):
        slots = [((int.from_bytes(raw[i : i + n], "little") + n) * 0x9E3779B97F4A7C15 & mask) >> (64 - quality_rules.BITS) for i in range(len(raw) - n + 1)]
        out += sum(float(model.weights[1][s]) for s in slots) / max(1, len(slots))
    w = WORD.findall(text or "")
    h = t.hash_strings(w) if w else np.zeros(0, np.uint64)
    for n in (1, 2):
        grams = [int(h[i]) if n == 1 else int(t.rolled(h[i : i + 2], np.array([0]), np.array([2]), t.WORDS)[0]) for i in range(len(w) - n + 1)]
        out += sum(float(model.weights[0][g >> (64 - quality_rules.BITS)]) for g in grams) / max(1, len(grams))
    return out


def test_probability_and_verdict(docs, documents, graded, monkeypatch):
    """Probabilities by brute force from the fitted weights, and the verdict at the threshold."""
    learned, labels, _ = graded
    texts, y = quality_rules.labelled_sample(learned, labels, "quality", 200)
    model = quality_rules.fit(texts, y)
    monkeypatch.setattr(quality_rules, "fit", lambda *_: model)
    got = sorted((r["doc_id"] or -1, r["probability"], r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(docs, labels, threshold=0.6).collect())
    want = sorted((i or -1, 1 / (1 + math.exp(-min(40, max(-40, model.slope * brute_margin(x, model) + model.shift))))) for i, x, *_ in documents)
    assert [g[0] for g in got] == [x[0] for x in want]
    assert [g[1] for g in got] == pytest.approx([x[1] for x in want], abs=1e-5)
    assert all(kept == (not failed and p >= 0.6) for _, p, failed, kept in got)


def test_calibration():
    """Platt's sigmoid has the least log loss on smoothed targets among its neighbours."""
    rng = np.random.default_rng(1)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * m - 0.5)))).astype(float)
    slope, shift = quality_rules.platt(m, y)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * m + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert 1 < slope < 3
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_contradictory_labels(graded, spark):
    """An id with both labels teaches nothing, whatever the order of the rows; extra columns and clashing names change nothing."""
    docs, labels, _ = graded
    both = labels.unionAll(spark.createDataFrame([(2, 0, 0), (4, 0, 0), (5, 1, 0)], labels.schema))
    wide = docs.withColumns({n: F.lit(1) for n in ("label", "score", "probability", "n_words", "kept", "log_words", "most")})
    for parts in (1, 4):
        got = {r["doc_id"]: r["label"] for r in quality_rules.agreed(both.repartition(parts), "quality").collect()}
        assert not {2, 4, 5} & set(got) and got[7] == 0 and got[8] == 1 and got[10] == 1
    for f in (quality_rules.quality_rules, rule_ensemble.quality_scores):
        rows = [sorted(map(str, f(d, x).collect())) for d, x in ((docs, both.repartition(1)), (wide, both.repartition(4)))]
        assert rows[0] == rows[1]


# --- operator 5 -------------------------------------------------------------------


def test_language_of_documents(docs, documents):
    got = language_id.language_ids(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(documents)
    for i, x, lang, *_ in documents:
        letters = any(c.isalpha() for c in x or "")
        if i is not None:
            assert by[i]["held_out"] == (fold(i, 4) == 2)
            assert (by[i]["lang_pred"] == "und") == (not letters), i
    held = [(i, lang) for i, x, lang, *_ in documents if i is not None and i < 60 and fold(i, 4) == 2 and len(x) > 40]
    assert np.mean([by[i]["lang_pred"] == lang for i, lang in held]) > 0.9


def test_mixed_language_spans(spark, docs):
    rng = random.Random(3)
    x = text_of(rng, "en", 100) + " " + text_of(rng, "ru", 150) + " " + text_of(rng, "fr", 60)
    model = language_id.learn(docs.where("lang is not null and text is not null and doc_id < 60").select("text", "lang"))
    r = language_id.labelled_spans(spark.createDataFrame([(1, x)], "doc_id long, text string"), model, 10.0).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "ru", "fr"] and r["lang_pred"] == "ru"
    assert abs(r["spans"][0]["end_word"] - 100) <= 2 and r["spans"][-1]["end_word"] == 310


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for states in (1, 2, 4, 20):
        first = np.concatenate([[0], np.cumsum([0, 1, 63, 64, 65, 200, 0, 5])])
        s = rng.normal(size=(first[-1], states))
        got = language_id.viterbi(s, first, 1.5)
        for a, z in zip(first[:-1], first[1:]):
            best, back = np.zeros(states), []
            for k in range(a, z):
                stay, jump = best, best.max() - 1.5
                back.append(np.where(jump > stay, best.argmax(), np.arange(states)))
                best = np.maximum(stay, jump) + s[k]
            value = lambda path: sum(s[a + k, p] for k, p in enumerate(path)) - 1.5 * sum(p != q for p, q in zip(path, path[1:]))  # noqa: B023,E731
            assert value(got[a:z].tolist()) == pytest.approx(best.max() if z > a else 0.0)


def test_language_edges(clashing, empty, documents, spark):
    kept = language_id.of_known_language(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, x, *_ in documents if i is not None and i < 60 and len(x) > 40}
    assert not {901, 902, 903, 900} & {r["doc_id"] for r in kept.collect()}
    assert language_id.language_ids(empty).count() == 0 and language_id.of_known_language(empty).count() == 0
    nobody = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language_id.language_ids(nobody).first()["lang_pred"] == "und"


def test_all_letters_count(spark, docs):
    """Whatever Unicode calls a letter, up to the last plane that has some."""
    import unicodedata

    points = [i for i in (0x41, 0xE9, 0x4E00, 0x31FFF, 0x3134A, 0x323AF, 0x2FA1D, 0x1F600, 0x32, 0xE0041) if unicodedata.category(chr(i)) != "Cn"]
    frame = spark.createDataFrame([(i, chr(i), None) for i in points], SCHEMA.split(", source")[0]).unionByName(docs.select("doc_id", "text", "lang").where("doc_id < 20 and doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 10**7))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_ids(frame).collect()}
    for i in points:
        assert (got[i] == "und") == (unicodedata.category(chr(i))[0] != "L"), hex(i)


def test_more_languages_than_256(spark):
    """Each of 300 labels has words of its own, and is found."""
    rng = random.Random(4)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(30))
    docs = spark.createDataFrame([(600 * c + k, make(k), f"l{k:03}") for c in range(3) for k in range(300)], "doc_id long, text string, lang string").repartition(2)
    rows = docs.where("doc_id < 1200")
    model = language_id.learn(rows.select("text", "lang"))
    assert len(model.languages) == 300
    got = language_id.labelled_spans(docs.where("doc_id >= 1200"), model, 10.0).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] - 1200:03}" for r in got]) > 0.95 and len(got) == 300


def test_trigram_scores_by_brute_force(spark):
    """The scores of words from trigram counts by dictionaries, slots and all, and the script penalty."""
    texts = [("The cat, the hat", "en"), ("le chat \u00e0 l'eau", "fr"), ("кот и кит", "ru"), ("the dog", "en")]
    model = language_id.learn(spark.createDataFrame(texts, "text string, lang string").repartition(2))
    assert model.languages == ["en", "fr", "ru"]
    slots, mask = 1 << model.bits, (1 << 64) - 1

    def grams(word):
        b = [c if c >= 128 else (c | 0x20 if chr(c).isalpha() else 0x20) for c in word.encode()]
        at = lambda i: b[i] if 0 <= i < len(b) else 0x20
        return [((at(i - 1) | at(i) << 8 | at(i + 1) << 16) + 1) * 0x9E3779B97F4A7C15 % (mask + 1) >> (64 - model.bits) for i in range(len(b)) if b[i] != 0x20]

    counts = {x: Counter(g for text, lang in texts if lang == x for w in WORD.findall(text) for g in grams(w)) for x in model.languages}
    total = {x: sum(c.values()) + 0.5 * slots for x, c in counts.items()}
    v = language_id.view(*[np.frombuffer("The chat кит zzz 12".encode(), np.uint8), np.array([0, 23])], model.bits)
    got = model.word_scores(v)
    for row, word in zip(got, ["The", "chat", "кит", "zzz", "12"], strict=True):
        want = np.zeros(3)
        for g in grams(word):
            p = np.array([math.log((counts[x][g] + 0.5) / total[x]) for x in model.languages])
            want += p - p.max()
        if any(c.isalpha() for c in word):
            want += np.where([("а" <= word[0] <= "я") == (x == "ru") for x in model.languages], 0, -30)
        assert row == pytest.approx(want, abs=1e-4)


def test_rejection_by_share(spark, docs):
    rng = random.Random(3)
    mixed = " ".join(text_of(rng, x, 60) for x in ("en", "ru", "fr"))
    flips = " ".join(rng.choice(LANGS[x]) for _ in range(60) for x in ("en", "ru", "ru", "fr"))
    rows = [(1, mixed, None), (2, "中文字符中文字符 the", None), (3, "中文 the cat sat on the mat", None), (4, "123", None), (5, "the", None)]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i + 10**6, x, y) for i, x, y in rows], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language_id.of_known_language(frame).collect()}
    assert {10**6 + 1, 10**6 + 3, 10**6 + 5} <= kept and not {10**6 + 2, 10**6 + 4} & kept
    # spans of one or two words count only where they are asked for
    model = language_id.learn(docs.where("lang is not null and text is not null").select("text", "lang"))
    b = np.frombuffer(flips.encode(), np.uint8)
    best, _, v, doc, label = language_id.shares(b, np.array([0, len(b)]), model, 0.1)
    at = language_id.span_starts(doc, label)
    want = [0] + [k for k in range(1, len(label)) if label[k] != label[k - 1]]
    assert at.tolist() == want and len(at) > 60


# --- operator 6 --------------------------------------------------------------------


def windows_of(text, percent):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    pairs, found = list(zip(w, w[1:])), {}
    for name, template in license_scan.TEMPLATES.items():
        wanted, width = set(license_scan.template_shingles(template)), license_scan.window_of(template)
        hits = [(len(wanted & set(pairs[k : k + width - 1])), k) for k in range(0, len(pairs), width // 2)]
        good = [(c, k) for c, k in hits if c >= license_scan.required(template, percent)]
        if good:
            found[name] = (max(c for c, _ in good), len(wanted), min(k for _, k in good))
    return found


def test_licenses(spark, documents, empty):
    texts = [(i, x) for i, x, *_ in documents if i is not None][:30]
    names = list(license_scan.TEMPLATES)
    for k, name in enumerate(names):
        w = license_scan.TEMPLATES[name].split()
        texts.append((2000 + k, "Some words before. " * k + license_scan.TEMPLATES[name] + " and after"))
        del w[len(w) // 2]
        texts.append((3000 + k, "x " * (3 * k) + " ".join(w).upper() + "\n"))
    texts += [(4000, None), (4001, ""), (4002, "license"), (None, license_scan.TEMPLATES["MIT-line"])]
    got = license_scan.license_matches(spark.createDataFrame(texts, "doc_id long, text string"), percent=80)
    want = Counter((i, n, *v) for i, x in texts for n, v in windows_of(x, 80).items())
    assert as_rows(got, "doc_id", "license_id", "shared", "total", "first_word") == want
    assert {i for i, *_ in want} >= {2000 + k for k in range(len(names))}
    assert license_scan.license_matches(empty).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_templates_are_checked(docs):
    with pytest.raises(ValueError):
        license_scan.license_matches(docs, {"one": "word"})


# --- operator 7 ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, documents, name):
    path = P.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        n = lambda x: len(library.encode(x, add_special_tokens=False))
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda x: len(library.encode(x))
    got = counts.token_counts(docs, path, limit=100, table_size=50, cache_size=40)
    want = Counter((i, len((x or "").encode()), n(x or ""), n(x or "") > 100) for i, x, *_ in documents)
    assert as_rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_pieces_of_a_long_text():
    path = P.path("byte_bpe_50k.json")
    c = counts.Counting(path, {}, 1000)
    rng = random.Random(2)
    for _ in range(200):
        x = "".join(rng.choice(["a", "B ", "  ", "\n", "'s", "9", "é", "!?", "\t ", "<|endoftext|>", "word"]) for _ in range(60))
        assert "".join(counts.pieces(x, 7)) == x
        want = len(c.library.encode(x, add_special_tokens=False))
        assert c.count(x) == want
        if "<|" not in x:
            assert sum(c.lengths(c.find(p)) for p in counts.pieces(x, 7)) == want


def test_token_counts_edges(clashing, empty, documents):
    path = P.path("byte_bpe_50k.json")
    assert counts.token_counts(clashing, path).count() == len(documents)
    assert counts.token_counts(empty, path).count() == 0


# --- operator 10 ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def samples():
    rng, out = random.Random(5), [x or "" for _, x, *_ in rows()]
    source = "the unbelievable tokenization aaaa abab    x  \n\n\t é中文😀▁<s>0x41 12345 don't русский".split(" ") + [" ", "  ", "\n", "é", "▁"]
    return out + ["".join(rng.choice(source) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_encoding_equals_the_library(model):
    c, library = model
    for x in samples():
        ids = np.frombuffer(c.encode(x), np.int32)
        assert ids.tolist() == library.encode(x), x
        assert c.decode(ids) == library.decode(ids.tolist()) == x.replace("▁", " ")


def test_chunks_equal_the_library(model):
    c, library = model
    rng = random.Random(6)
    for x in samples():
        text = c.escaped(x[:400])
        if not text:
            continue
        size = rng.choice([3, 7, 20, 64])
        cuts = [*range(0, len(text), size), len(text)]
        matrices = [c.transfer(text, a, z) for a, z in zip(cuts, cuts[1:])]
        total = matrices[0][:1]
        for m in matrices[1:]:
            total = codec.max_plus(total, m)
        final = [j for j, (_, z) in enumerate(c.states(text, len(text))) if z == len(text) and np.isfinite(total[0, j])]
        assert len(final) == 1
        leave = codec.states_at_cuts(matrices, 0, final[0])
        out = b"".join(c.traced(text, c.states(text, a)[0 if k == 0 else leave[k - 1]], c.states(text, z)[leave[k]]) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
        assert np.frombuffer(out, np.int32).tolist() == library.encode(x[:400])


def test_max_plus_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random(s) < 0.3, -np.inf, rng.integers(-9, 9, s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert (codec.max_plus(codec.max_plus(a, b), c) == codec.max_plus(a, codec.max_plus(b, c))).all()


def test_open_arcs(model):
    c, _ = model
    rng, names = random.Random(8), [x for x in c.id if len(x) < 6 and x not in c.tied]
    for _ in range(5000):
        a, b = rng.choice(names), rng.choice(names)
        if codec.SPACE not in b:
            assert c.border_stays(a, b) == (c.merged(a + b)[0] == [a, b])


def test_encoding_query(docs, clashing, empty, documents, model, monkeypatch):
    _, library = model
    path = P.path("piece_bpe_32k.model")
    want = Counter((i, len(e), zlib.crc32(np.array(e, np.int32).tobytes()), True) for i, e in ((i, library.encode(x or "")) for i, x, *_ in documents))
    for giant in (1 << 16, 500):
        got = codec.encoding_digests(docs, path, giant=giant, chunk=97)
        assert as_rows(got, "doc_id", "n_tokens", "ids_crc", "round_trip") == want
    got = codec.encoding_digests(clashing, path, keep_ids=True)
    assert as_rows(got, "doc_id", "n_tokens", "ids_crc", "round_trip") == want
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in got.collect())
    assert codec.encoding_digests(empty, path).count() == 0
    monkeypatch.setattr(codec, "FAN", 4)  # the matrices of the longest text by a tree of five levels
    got = codec.encoding_digests(docs, path, giant=500, chunk=50)
    assert as_rows(got, "doc_id", "n_tokens", "ids_crc", "round_trip") == want
    back = codec.decoded(codec.encoded(docs, path, giant=500, chunk=64), path)
    assert as_rows(back, "doc_id", "text") == Counter((i, (x or "").replace("▁", " ")) for i, x, *_ in documents)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(bytes([0x12, 2, 0x18, 1, 0x1A, 2, 0x18, 1]))
    with pytest.raises(ValueError):
        codec.Codec(str(tmp_path / "m.model"))
