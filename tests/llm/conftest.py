import random

import pytest

LANGS = {
    "en": "the of and to in that was with for on are by this be an it at from which have not but they his her she has had were their been more when who will one all there can would about out up so what said its into than them time only some could these two may then do first any".split(),
    "fr": "le la les des une dans pour que qui est sur avec par plus pas ce au sont cette ses mais nous vous leur fait être même tout deux aussi comme après ans sans où très donc peu encore été déjà".split(),
    "ru": "и в не на что он как это но по из она так его все мы вы они был для же от если или уже когда до вот мне ему только ещё быть надо этот".split(),
}


def text_of(rng, lang, n):
    out = []
    for i in range(n):
        out.append(rng.choice(LANGS[lang]) + rng.choice(["", "", "", "s", "n", "er"]) if lang != "ru" else rng.choice(LANGS[lang]))
        if i % 12 == 11:
            out[-1] += rng.choice([".", ".\n", ","])
    return " ".join(out)


def rows(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and odd rows."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = ["en", "fr", "ru"][i % 3]
        out.append([i, text_of(rng, lang, rng.randint(1, 160)), lang])
    for i in range(8):  # copies, and copies with a changed word
        w = out[i][1].split(" ")
        out.append([n + 2 * i, out[i][1], out[i][2]])
        w[len(w) // 2] = "Changed"
        out.append([n + 2 * i + 1, " ".join(w), out[i][2]])
    passage = text_of(rng, "en", 70)
    for i in range(4):
        out.append([n + 40 + i, text_of(rng, "en", 20 + i) + " " + passage + " " + text_of(rng, "en", 15), "en"])
    out += [
        [900, None, "en"],
        [901, "", None],
        [902, " \t\n \x0b\x0c\r ", "fr"],
        [903, "12345 !!! ###", "en"],
        [904, "one", "en"],
        [905, "one", "en"],
        [906, "x" * 5000, None],
        [907, ("la la la " * 400).strip(), "fr"],
        [908, text_of(rng, "en", 6000), "en"],
        [909, "中文字符 😀 é́ ▁ <|endoftext|> tail", None],
        [910, "a  b\n\na  b\n\n  c\n", "en"],
        [None, text_of(rng, "en", 80), "en"],
        [None, None, None],
    ]
    out.append(list(out[3]))  # a repeated row
    return [(i, t, lang, f"s{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return rows()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, documents):
    """The same with columns whose names the operators use themselves."""
    extra = ["key", "token", "class", "row", "score", "ids", "text_key", "spans", "cut_key", "hashes", "label", "count"]
    wide = [(*r, *([7] * len(extra))) for r in documents]
    return spark.createDataFrame(wide, SCHEMA + "".join(f", `{x}` int" for x in extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
