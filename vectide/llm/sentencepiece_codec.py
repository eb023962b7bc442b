"""SentencePiece encoding and decoding by a max-plus scan (operator 10).

The vocabularies at hand are BPE models, for which the best sum of piece scores
is not what the library returns. They fit the max-plus form all the same: a
sequence of pieces is the BPE encoding of its text exactly if every two
neighbours are the encoding of what they spell together. So an arc from piece a
to piece b weighs 0 if (a, b) is such a pair and minus infinity otherwise, and
the one path of finite weight is the encoding. Results equal the library's, id
by id; tests hold them against it.

* Ordinary texts: a piece never runs on into white space, nor from a letter into
  most punctuation (this is read off the model), so a text falls into units at
  such borders, each encoded once per worker and kept in a bounded cache.
* Giant texts are cut into chunks of ``chunk`` characters at arbitrary places and
  dealt to all tasks. The state at a cut is the piece over its last character;
  every piece that matches there is a candidate. A chunk yields the matrix of
  weights from the states at its start to those at its end. The matrices of a
  text are combined (an associative max-plus product) by a tree of 64 branches,
  which fixes the state at every cut on the way down, and each chunk is then traced
  back on its own. Only the ids of a text meet in one row.

Edge cases: a null text counts as empty and has no ids; U+2581 is encoded as a
space, as by the library; characters outside the vocabulary become byte pieces;
repeated rows and null ids are kept; an empty table gives no rows; extra columns
are ignored. Models with a normaliser, user-defined pieces or another algorithm
are refused.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm._spark import Scratch, batch, lean

SPACE = "▁"
#: A letter, as a regular expression.
LETTER = r"[^\W\d_]"
MINUS = -np.inf
SHORT = (3, 2, 1)


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


class PackedIds(dict):
    """The id of a piece as four bytes; the bytes of an unknown character as the ids of byte pieces."""

    def __init__(self, ids: dict[str, int], byte_ids: dict[int, int] | None, unknown: int):
        super().__init__((x, struct.pack("<i", i)) for x, i in ids.items())
        self.byte_ids, self.unknown = byte_ids, unknown

    def __missing__(self, piece: str) -> bytes:
        return struct.pack(f"<{len(piece.encode())}i", *map(self.byte_ids.__getitem__, piece.encode())) if self.byte_ids else struct.pack("<i", self.unknown)


class Codec:
    """Encodes and decodes with one SentencePiece BPE model."""

    def __init__(self, path: str, cache_size: int = 200_000):
        with open(path, "rb") as f:
            message = list(wire(f.read()))
        trainer = dict(wire(next(v for k, v in message if k == 2)))
        normaliser = dict(wire(next(v for k, v in message if k == 3)))
        pieces = [dict(wire(v)) for k, v in message if k == 1]
        # fixed values of the format: kinds of pieces 1 normal, 2 unknown, 4 user-defined, 6 byte; model kind 2 is BPE
        kinds = [p.get(3, 1) for p in pieces]
        if trainer.get(3) != 2 or trainer.get(24) or normaliser.get(2) or normaliser.get(4, 1) or 4 in kinds:
            raise ValueError("only plain BPE models without a normaliser are supported")
        self.names = [p[1].decode() for p in pieces]
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        score = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        self.id = {x: i for i, x in enumerate(self.names) if kinds[i] == 1}
        self.score = {x: score[i] for x, i in self.id.items()}
        byte_ids = {int(x[3:5], 16): i for i, x in enumerate(self.names) if kinds[i] == 6}
        # whether arcs are open, by their first and second piece
        self.arcs: dict[str, dict[str, bool]] = {}
        self.n_arcs, self.most_arcs = 0, 300_000
        uses = Counter(self.score.values())
        self.tied = {x for x, v in self.score.items() if uses[v] > 1}
        # the two parts of every piece; a piece that merging its characters doesn't give is never used
        self.parts: dict[str, tuple[str, str]] = {}
        for x in [x for x in self.id if len(x) > 1]:
            found, last = self.merged(x)
            if found == [x]:
                self.parts[x] = last
            else:
                del self.id[x]
        self.longest = max(map(len, self.id))
        # marks that no piece has after a letter: every path has a piece that ends before such a mark
        before: dict[str, set[str]] = {}
        for x in self.id:
            for a, b in zip(x, x[1:], strict=False):
                before.setdefault(b, set()).add(a)
        marks = "".join(re.escape(m) for m in string.punctuation if not any(re.match(LETTER, a) for a in before.get(m, ())))
        stop = f"[{SPACE}\n{marks}]"
        common = "[a-zA-ZÀ-ÖØ-öø-ÿ]"  # letters that are tried first, for speed
        self.units = re.compile(f"{SPACE}?{common}++(?={stop}|\\Z)|{SPACE}*+(?:{LETTER}++(?={stop}|\\Z)|[^{SPACE}\n]++)|{SPACE}++|\n")
        # the lengths that pieces with these four first characters can have, the longest first
        sizes: dict[str, set[int]] = {}
        for x in self.id:
            if len(x) > 3:
                sizes.setdefault(x[:4], {1, 2, 3}).add(len(x))
        self.sizes = {x: tuple(sorted(n, reverse=True)) for x, n in sizes.items()}
        if any(SPACE in x.lstrip(SPACE) for x in self.id) or any("\n" in x for x in self.id if len(x) > 1):
            raise ValueError("pieces that run on into white space are not supported")
        self.bytes = [b"" if k in (2, 3) else bytes([int(x[3:5], 16)]) if k == 6 else x.replace(SPACE, " ").encode() for x, k in zip(self.names, kinds, strict=True)]
        self.words = PackedIds(self.id, byte_ids if trainer.get(35) and len(byte_ids) == 256 else None, kinds.index(2))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_size = cache_size

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The encoding of a short text by merging the best pair, leftmost first, and the last pair merged."""
        parts, last = list(text), None
        scores = [self.score.get(a + b, MINUS) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != MINUS:
            i = scores.index(best)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score.get(parts[i - 1] + parts[i], MINUS)
            if i < len(scores):
                scores[i] = self.score.get(parts[i] + parts[i + 1], MINUS)
        return parts, last

    def follows(self, a: str, b: str) -> bool:
        """Whether the arc from piece a to piece b is open: whether merging a + b leaves the border between them."""
        arcs = self.arcs.setdefault(a, {})
        found = arcs.get(b)
        if found is None:
            if self.n_arcs >= self.most_arcs:
                for x in self.arcs.values():
                    x.clear()
                self.n_arcs = 0
            self.n_arcs += 1
            found = arcs[b] = self.merged(a + b)[0] == [a, b] if self.ties(a) or self.ties(b) else self.border_stays(a, b)
        return found

    def ties(self, piece: str) -> bool:
        """Whether a piece is one of those that share a score, whose order the ranks don't tell."""
        return piece in self.tied

    def border_stays(self, a: str, b: str) -> bool:
        """Goes back through the merges of a and b, the later first, and asks of each pair at the border whether it would have been merged by then."""
        score, parts = self.score, self.parts
        bound, strict = MINUS, True  # a pair merges if its score is above the bound, or equal and not strict
        while True:
            s = score.get(a + b, MINUS)
            if s > bound or s == bound != MINUS and not strict:
                return False
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                return True
            # of equal scores the merge on the left comes first, so the right one is the later
            if right is None or left is not None and score[a] < score[b]:
                bound, strict, a = score[a], True, left[1]
            else:
                bound, strict, b = score[b], False, right[0]

    def last_pieces(self, text: str, begin: int, end: int, state: str | None, known: list | None = None) -> list[str | None]:
        """The last piece of the path to each place begin + 1 .. end that comes from ``state`` at ``begin``; None where there is none.

        known: the same from another state; once the paths agree for the length of a piece, they stay the same.
        """
        last: list[str | None] = [None] * (end - begin + 1)
        ids, follows, longest, same = self.id, self.follows, self.longest, 0
        for i in range(begin + 1, end + 1):
            for start in range(max(begin, i - longest), i):
                before = last[start - begin] if start > begin else state
                if before is None and (start > begin or state is not None):
                    continue
                piece = text[start:i]
                if (piece in ids or start == i - 1) and (before is None or follows(before, piece)):
                    last[i - begin] = piece
                    break
            if known is not None:
                same = same + 1 if known[i] is not None and known[i] == last[i - begin] else 0
                if same >= 2 * longest:
                    last[i - begin + 1 :] = known[i + 1 : end + 1]
                    break
        return last

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in which spaces are U+2581: the open path, searched depth first, long pieces first.

        A place has one possible last piece, so a place that leads nowhere is closed for good.
        """
        n, ids, sizes_at, arcs, follows = len(text), self.id, self.sizes.get, self.arcs, self.follows
        out: list[str] = []
        closed: set[int] = set()
        at, below, before, leads = 0, n + 1, None, None
        while at < n:
            for size in sizes_at(text[at : at + 4], SHORT):
                end = at + size
                if size >= below or end > n or end in closed:
                    continue
                piece = text[at:end]
                if size > 1 and piece not in ids:
                    continue
                if before is not None:
                    is_open = leads.get(piece)
                    if is_open is None:
                        is_open = follows(before, piece)
                    if not is_open:
                        continue
                out.append(piece)
                at, below, before = end, n + 1, piece
                leads = arcs.get(piece)
                if leads is None:
                    leads = arcs[piece] = {}
                break
            else:
                closed.add(at)
                below = len(out.pop())
                at -= below
                before = out[-1] if out else None
                leads = arcs.get(before)
        return out

    def packed(self, pieces: list[str]) -> bytes:
        """The ids of pieces as 32-bit integers."""
        return b"".join(map(self.words.__getitem__, pieces))

    def escaped(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return self.encode_escaped(self.escaped(text))

    def encode_escaped(self, text: str) -> bytes:
        units, cache = self.units.findall(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, units))
        except KeyError:
            out = []
            for u in units:
                x = cache.get(u)
                if x is None:
                    x = self.older.get(u)
                    if x is None:
                        x = self.packed(self.pieces(u))
                    if len(u) <= 64:
                        if len(cache) >= self.cache_size // 2:  # what is used again comes back from the older half
                            self.older, self.cache = cache, {}
                            cache = self.cache
                        cache[u] = x
                out.append(x)
            return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def spells(self, ids: bytes, text: str) -> bool:
        """Whether the ids decode to this text, in which spaces are U+2581, prefix included."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, np.int32).tolist())) == text.replace(SPACE, " ").encode()

    # --- giant texts -------------------------------------------------------

    def states(self, text: str, cut: int) -> list[tuple[str | None, int]]:
        """(piece, its end) of all pieces over the character before ``cut``; the start of a text is (None, 0)."""
        if cut == 0:
            return [(None, 0)]
        found = []
        for start in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), start + self.longest) + 1):
                if (p := text[start:end]) in self.id or (end == cut and start == cut - 1):
                    found.append((p, end))
        return found

    @staticmethod
    def is_border(text: str, i: int) -> bool:
        """Whether every path has a piece that ends at i."""
        return text[i] == SPACE and text[i - 1] != SPACE or text[i] == "\n" or text[i - 1] == "\n"

    def borders(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place in begin + 1 .. end - 1 where every path has a piece that ends."""
        first = next((i for i in range(begin + 1, end) if self.is_border(text, i)), None)
        return None if first is None else (first, next(i for i in range(end - 1, begin, -1) if self.is_border(text, i)))

    def transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """Weights from states(begin) to states(end): 0 for a path, minus infinity for none."""
        enter, leave = self.states(text, begin), self.states(text, end)
        limit = min(len(text), end + self.longest - 1)
        between = self.borders(text, max(at for _, at in enter), min(z - len(p) for p, z in leave))
        if between:  # all paths meet at borders, so the matrix is a product of a column and a row
            first, last = between
            column = [0.0 if self.last_pieces(text, at, first, piece)[-1] is not None else MINUS for piece, at in enter]
            tail = self.last_pieces(text, last, limit, None)
            row = [0.0 if tail[z - last] == p else MINUS for p, z in leave]
            return np.add.outer(np.array(column), np.array(row))
        out, known = np.full((len(enter), len(leave)), MINUS), None
        for i, (piece, at) in enumerate(enter):
            last = [None] * at + self.last_pieces(text, at, limit, piece, known)
            for j, (p, z) in enumerate(leave):
                if z == at and p == piece or z > at and last[z] == p:
                    out[i, j] = 0.0
            if known is None and piece is not None:
                known = last
        return out

    def traced(self, text: str, enter: tuple[str | None, int], leave: tuple[str, int]) -> bytes:
        """The ids of the pieces from state ``enter`` (not included) to state ``leave``."""
        begin, end = enter[1], leave[1]
        between = self.borders(text, begin, end)
        stop = between[0] if between else end
        last, i, out = self.last_pieces(text, begin, stop, enter[0]), stop, []
        while i > begin:
            out.append(last[i - begin])
            i -= len(last[i - begin])
        return self.packed(out[::-1]) + self.encode_escaped(text[stop:end])


#: Neighbouring matrices that one task combines.
FAN = 64


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), MINUS)


def states_at_cuts(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The state at the end of every chunk of the path from state ``enter`` to state ``leave``."""
    prefix = [matrices[0][enter : enter + 1]]
    for m in matrices[1:]:
        prefix.append(max_plus(prefix[-1], m))
    state, out = leave, []
    for k in range(len(matrices) - 1, -1, -1):
        out.append(state)
        if k:
            state = int((prefix[k - 1][0] + matrices[k][:, state]).argmax())
    return out[::-1]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


CHUNK = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
CHUNK_DDL = "row long, doc_id long, chunk long, text string, begin long, end long"


def chunked(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Chunks of docs(doc_id, text) with as much text around them as a piece can reach; [begin, end) is the chunk in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row = codec(path), TaskContext.get().partitionId() << 32
        for rb in batches:
            for doc_id, value in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                text, row = c.escaped(value.as_py()), row + 1
                n = -(-len(text) // chunk)
                for k in range(n):
                    left, right = max(0, k * chunk - c.longest), min(len(text), (k + 1) * chunk + c.longest)
                    yield batch(CHUNK, [row], [doc_id], [k], [text[left:right]], [k * chunk - left], [min(len(text), (k + 1) * chunk) - left])

    return docs.mapInArrow(lean(run), CHUNK_DDL)


def giant_ids(docs: DataFrame, path: str, chunk: int, scratch: Scratch) -> DataFrame:
    """(doc_id, exact, ids) of docs(doc_id, text), none of them empty, by chunks that any task may take."""
    fan = FAN
    parts = scratch.save(chunked(docs, path, chunk).repartition("row", "chunk"))
    matrix = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("states", pa.int64()), ("weights", pa.binary()), ("ends", pa.list_(pa.int64()))])
    between = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("enter", pa.int64()), ("leave", pa.int64())])
    ids = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("exact", pa.bool_()), ("chunk", pa.int64()), ("ids", pa.binary())])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rb in batches:
            for r in rb.to_pylist():
                m = c.transfer(r["text"], r["begin"], r["end"])
                whole = [j for j, (_, z) in enumerate(c.states(r["text"], r["end"])) if z == r["end"]]
                yield batch(matrix, [r["row"]], [r["chunk"]], [m.shape[0]], [m.tobytes()], [whole])

    def in_order(table: pa.Table) -> tuple[list[dict], list[np.ndarray]]:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        return rows, [np.frombuffer(r["weights"]).reshape(r["states"], -1) for r in rows]

    def combine(table: pa.Table) -> pa.Table:
        """One matrix for ``fan`` neighbouring ones."""
        rows, matrices = in_order(table)
        total = reduce(max_plus, matrices)
        return pa.table([[rows[0]["row"]], [rows[0]["chunk"] // fan], [total.shape[0]], [total.tobytes()], [rows[-1]["ends"]]], schema=matrix)

    def descend(table: pa.Table) -> pa.Table:
        """The states at the cuts inside a part of which the outer ones are known (outer_leave null: the part is a text)."""
        rows, matrices = in_order(table)
        enter, final = rows[0]["outer_enter"], rows[0]["outer_leave"]
        if final is None:
            total = reduce(max_plus, matrices[1:], matrices[0][enter : enter + 1])
            final = next(j for j in rows[-1]["ends"] if np.isfinite(total[0, j]))
        leave = states_at_cuts(matrices, enter, final)
        return pa.table([[r["row"] for r in rows], [r["chunk"] for r in rows], [enter, *leave[:-1]], leave], schema=between)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rb in batches:
            for r in rb.to_pylist():
                enter, leave = c.states(r["text"], r["begin"])[r["enter"]], c.states(r["text"], r["end"])[r["leave"]]
                found = c.traced(r["text"], enter, leave)
                yield batch(ids, [r["row"]], [r["doc_id"]], [c.spells(found, r["text"][enter[1] : leave[1]])], [r["chunk"]], [found])

    ddl = "row long, chunk long, states long, weights binary, ends array<long>"
    levels, most = [parts.mapInArrow(lean(transfers), ddl)], parts.agg(F.max("chunk")).first()[0] or 0
    outer = F.floor(F.col("chunk") / fan)
    while most >= fan:  # a level is read on the way up and on the way down
        levels[-1] = scratch.save(levels[-1])
        levels.append(levels[-1].groupBy("row", outer).applyInArrow(combine, ddl))
        most //= fan
    cuts = None
    for level in reversed(levels):
        if cuts is None:
            inside = level.withColumns({"outer_enter": F.lit(0).cast("long"), "outer_leave": F.lit(None).cast("long")})
        else:
            inside = level.withColumn("outer", outer).join(cuts.select("row", F.col("chunk").alias("outer"), F.col("enter").alias("outer_enter"), F.col("leave").alias("outer_leave")), ["row", "outer"])
        cuts = inside.groupBy("row", outer).applyInArrow(descend, "row long, chunk long, enter long, leave long")
    traced = parts.join(cuts, ["row", "chunk"]).select("row", "doc_id", "chunk", "text", "begin", "end", "enter", "leave")
    traced = traced.mapInArrow(lean(trace), "row long, doc_id long, exact boolean, chunk long, ids binary")
    joined = F.expr("unhex(array_join(transform(array_sort(collect_list(struct(chunk, ids))), x -> hex(x.ids)), ''))")
    return traced.groupBy("row", "doc_id").agg(joined.alias("ids"), F.bool_and("exact").alias("exact")).select("doc_id", "exact", "ids")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc", pa.int64()), ("round_trip", pa.bool_())])


def _encoded(docs: DataFrame, path: str, giant: int, chunk: int, with_ids: bool) -> DataFrame:
    """(doc_id, n_tokens, ids_crc, round_trip) and, with_ids, token_ids. Encoding and decoding share one Python worker, so a text travels once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = DIGEST.append(pa.field("token_ids", pa.binary())) if with_ids else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [c.encode(x) for x in texts]
                good = [c.spells(i, c.escaped(x)) for i, x in zip(ids, texts, strict=True)]
                yield batch(schema, part.column(0), [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], good, *([ids] if with_ids else []))

    more = [F.col("ids").alias("token_ids")] if with_ids else []
    ddl = "doc_id long, n_tokens long, ids_crc long, round_trip boolean" + ", token_ids binary" * with_ids
    small = docs.where(F.length("text") <= giant).mapInArrow(lean(run), ddl)
    large = giant_ids(docs.where(F.length("text") > giant), path, chunk, Scratch(docs.sparkSession))
    return small.unionAll(large.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc"), F.col("exact").alias("round_trip"), *more))


def encoded(docs: DataFrame, path: str, giant: int = 1 << 16, chunk: int = 1 << 13) -> DataFrame:
    """(doc_id, token_ids) of docs(doc_id, text): ids as 32-bit little-endian integers in one binary value.

    Texts of more than ``giant`` characters take the way by chunks.
    """
    return _encoded(docs, path, giant, chunk, True).select("doc_id", "token_ids")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows(doc_id, token_ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rb in batches:
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                yield batch(schema, part.column(0), [None if x is None else c.decode(np.frombuffer(x, np.int32)) for x in part.column(1).to_pylist()])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(lean(run), "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str, giant: int = 1 << 16, chunk: int = 1 << 13, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc, round_trip) of every row: the number of ids, the CRC-32 of the ids, whether they decode to the text (U+2581 as a space).

    keep_ids: with the ids themselves, as in encoded(), in token_ids.
    """
    return _encoded(docs, path, giant, chunk, keep_ids)
