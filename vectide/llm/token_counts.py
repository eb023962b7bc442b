"""Token counts of whole texts: a two-tier map-side lookup (operator 7).

For a byte-level BPE vocabulary (.json) each text is cut into pre-tokens by the
vocabulary's own pattern. The first tier is a broadcast table with the token
lengths of frequent pre-tokens; what it lacks is encoded by the library once per
worker and kept in a bounded worker cache, the second tier. No pre-token is ever
shuffled: only bounded per-task summaries of frequent words are.

The first tier changes speed, never results: lengths in both tiers come from the
library. ``table_size`` bounds the broadcast (65,536 strings of 64 characters), ``cache_size`` a
worker's memory. Other vocabularies (.json of another kind, .model) have no
context-free pre-tokens and are encoded by their library text by text.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and
null ids are kept as they are; an empty table gives no rows; extra columns are
ignored. Texts of any length are cut before white space that follows a
non-space, where a pre-token always ends, so memory stays bounded.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm._spark import batch, lean

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 1 << 18
#: Characters of an entry of the broadcast table.
LONGEST = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def is_byte_level(path: str) -> bool:
    """Whether pre-tokens of this vocabulary are those of BYTE_LEVEL on the text as it is."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in d.get("added_tokens", []))


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters that begin with white space after a non-space."""
    import regex

    at, cut = 0, regex.compile(r"(?<=\S)\s")
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Counting:
    """Token lengths of pre-tokens in one worker: broadcast table, then cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int], cache_size: int):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(BYTE_LEVEL).findall
        self.frequent, self.cache, self.cache_size = frequent, {}, cache_size

    def lengths(self, found: list[str]) -> int:
        """The sum of the lengths of these pre-tokens."""
        tier1, tier2, total, missed = self.frequent.get, self.cache, 0, []
        for x in found:
            n = tier1(x)
            if n is None:
                missed.append(x)
            else:
                total += n
        if missed:
            new = list({x for x in missed if x not in tier2})
            if len(tier2) + len(new) > self.cache_size:
                tier2.clear()
                new = list(set(missed))
            if new:
                tier2.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            total += sum(map(tier2.__getitem__, missed))
        return total

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            for piece in pieces(part):
                total += self.lengths(self.find(piece))
        return total


def frequent_words(docs: DataFrame, table_size: int, per_task: int = 8192, held: int = 300_000) -> list[str]:
    """About the most frequent white-space words of all texts: each task reports its ``per_task`` most frequent ones."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                for piece in pieces(text.as_py() or ""):
                    seen.update(piece.split())
                if len(seen) > held:  # bounded memory: rare words go
                    seen = Counter(dict(seen.most_common(held // 4)))
        top = [(w, n) for w, n in seen.most_common(per_task) if len(w) <= LONGEST]
        yield batch(schema, [w for w, _ in top], [n for _, n in top])

    found = docs.select("text").mapInArrow(lean(summary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size)
    return [r[0] for r in found.select("word").collect()]  # table_size rows at most


def frequent_lengths(docs: DataFrame, path: str, table_size: int, cache_size: int) -> dict[str, int]:
    """Token lengths of the pre-tokens of frequent words, as they stand after a space and at the start of a line."""
    words = frequent_words(docs, table_size)
    c = Counting(path, {}, cache_size)
    table: dict[str, int] = {}
    for w in words:
        for x in c.find(" " + w) + c.find(w):
            if len(x) <= LONGEST and len(table) < table_size:
                table.setdefault(x, 0)
    keys = list(table)
    return dict(zip(keys, map(len, c.library.encode_batch_fast(keys, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, table_size: int = 1 << 16, cache_size: int = 300_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size, cache_size) if is_byte_level(path) else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            texts = b.column(1).fill_null("")
            if f is None:
                f = _counter(path, kept.value, cache_size)
            n = [f(t.as_py()) for t in texts]
            yield batch(ARROW, b.column(0), pa.compute.binary_length(texts).cast(pa.int64()), n)

    import pyarrow.compute  # noqa: F401

    out = docs.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_COUNTERS: dict[str, Counting] = {}


def _counter(path: str, frequent: dict[str, int] | None, cache_size: int):
    """The counting function of this worker for a vocabulary; a worker keeps its cache from task to task."""
    if frequent is not None:
        c = _COUNTERS.get(path)
        if c is None:
            c = _COUNTERS[path] = Counting(path, frequent, cache_size)
        c.frequent = frequent
        return c.count
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t, num_threads=1))
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False))
