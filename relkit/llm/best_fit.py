"""Best-fit packing: best-fit decreasing over a segment tree of capacities.

Pass 1 tokenizes every document once, cuts those longer than a sequence, and
numbers the pieces of each length within their task.  From the counts of a
length a task come a length's total and each task's first rank in it.

Best-fit decreasing depends on the lengths alone, and equal lengths are alike to
it.  A segment tree holds the number of open sequences by room left; going down
the lengths, it gives the least room that takes a piece in logarithmic time, and
all sequences of that room take pieces of that length in one step, as many as
best-fit would give each in turn.  So the whole packing of any number of pieces
is told by rules (from this rank on: that sequence, that place), whose number
depends on the size of a sequence and not on the table: at most 2 * size + 2
runs of sequences are opened or split off, and a run takes at most about
sqrt(2 * size) different lengths.

Pass 2 finds each piece's rule by bisection on its rank: the sequences are those
of best-fit decreasing over the whole table, with no partition of it packed apart.

Rules: null or empty text is the end id alone; the vocabulary's own special
token in a text is its one id, as ``tokenizers`` does by default.  A document of
more than ``size`` ids becomes pieces of ``size``, the first one shorter where
they do not divide.  Equal lengths take their ranks by task, then by the order
of rows in it, so a second run over other partitions may give other sequences,
as many and as full.  Repeated rows are packed as often as they come; an empty
table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relkit.llm.common import pick, ready, written

SIZE = 2048
END_ID = 0
#: Chunks whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Characters that are blank to some libraries only, and the special token: such texts are encoded whole.
ODD = re.compile(r"<\|endoftext\|>|[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")
#: A space within a run of blanks, where the text must not be cut.
INNER = re.compile(r"\s (?:\s|\Z)")
SEGMENT = re.compile(r" ?\S+|\s+(?!\S)|\s")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by ``tokenizers``, remembering words between blanks.

    The vocabulary's splitter never joins a word to what is behind it, only to
    one space before it, so a text's ids are those of its words, each with that
    space, and of its blanks.  Words met for the first time are encoded together;
    where one begins is told by the mark of a space in the first id's string."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.wide = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for w, i in vocab.items() if w.startswith("Ġ")]] = True
        self.after: dict[str, bytes] = {}   # word -> ids of " word"
        self.other: dict[str, bytes] = {}   # segment without a space before it -> ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.wide).tobytes()

    def _learn(self, new: list[str]) -> None:
        """``new``: words without blanks, at a space each."""
        flat = np.array(self.tok.encode(" " + " ".join(new), add_special_tokens=False).ids, self.wide)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(new):
            self.after.update((w, self.whole(" " + w)) for w in new)
            return
        raw, step = flat.tobytes(), flat.itemsize
        at = [*(starts * step).tolist(), len(raw)]
        self.after.update(zip(new, [raw[a:b] for a, b in zip(at, at[1:])]))

    def _segments(self, s: str) -> bytes:
        """Ids of a stretch, from those of its segments as they stand."""
        out = []
        for x in SEGMENT.findall(s):
            ids = self.after.get(x[1:]) if x[0] == " " else self.other.get(x)
            if ids is None:
                ids = self.whole(x)
                if x[0] == " " and not x.isspace():
                    self.after[x[1:]] = ids
                elif x[0] != " ":
                    self.other[x] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, 16 bits each if the vocabulary fits."""
        if len(self.after) + len(self.other) > REMEMBERED:
            self.after, self.other = {}, {}
        out, new = [], {}
        for t in texts:
            if ODD.search(t):
                out.append((self.whole(t), (), ()))
            elif INNER.search(t):
                out.append((self._segments(t), (), ()))
            else:
                head, *words = t.split(" ")
                ids = list(map(self.after.get, words))
                late = [(i, words[i]) for i, x in enumerate(ids) if x is None] if None in ids else ()
                new.update((w, None) for _, w in late if w.isalnum() or w.split() == [w])
                out.append((self._segments(head), ids, late))
        fresh = list(new)
        for i in range(0, len(fresh), 4000):
            self._learn(fresh[i:i + 4000])
        for _, ids, late in out:
            for i, w in late:
                ids[i] = self.after[w] if w in self.after else self._segments(" " + w)
        return [head + b"".join(ids) for head, ids, _ in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID,
           ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, task, place): the pieces of
    every document; ``place`` counts the pieces of equal length before it in its
    task.  ``ids`` are little-endian unsigned 32-bit, null if not asked for."""
    ready(docs.sparkSession)
    path = path or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        met = [0] * (size + 1)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(),
                                   enc.encode([t or "" for t in b.column("text").to_pylist()])):
                raw = np.frombuffer(raw, enc.wide).astype("<u4").tobytes() + end
                n, start, piece = len(raw) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % size + 1 if start == 0 else size
                    part = raw[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), part if ids else None, task,
                                 met[length]))
                    met[length] += 1
                    start, piece = start + length, piece + 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.int32(), pa.int64()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, task int, "
             "place bigint")


class Rooms:
    """Segment tree over room left, 0 to ``size``: each node knows how many open
    sequences are below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        at = self.leaves + length
        if self.count[at]:
            return length
        while at > 1:  # up until a right sibling holds some, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, rank, sequence, each, offset) of best-fit decreasing over
    ``counts`` pieces of each length: from ``rank`` on, ``each`` pieces a sequence
    go into the sequences from ``sequence`` on, the first of each at ``offset``."""
    tree, runs = Rooms(size), {}  # room -> [(first sequence, sequences)]
    rules, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = size
                n = -(-left // (size // length))
                put(room, opened, n)
                opened += n
            each = room // length
            first, n = runs[room].pop()
            tree.add(room, -n)
            full = min(n, left // each)
            some = left - full * each if full < n else 0  # the last sequence takes fewer
            rules.append((length, rank, first, each, size - room))
            if full:
                put(room - each * length, first, full)
            if some:
                put(room - some * length, first + full, 1)
            if n > full + (some > 0):
                put(room, first + full + (some > 0), n - full - (some > 0))
            rank += full * each + some
            left -= full * each + some
    return rules


def placed(table: DataFrame, size: int = SIZE) -> DataFrame:
    """``table`` (with ``length``, ``task``, ``place``) plus sequence_id and
    offset; a table that is read twice, so it should be a written one."""
    spark = table.sparkSession
    per_task = table.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = written(per_task.select(F.col("length").alias("of_length"), F.col("task").alias("of_task"), "n",
                                    F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "best-fit")
    # at most ``size`` rows
    counts = {r.of_length: r.n for r in ranks.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}
    rules = spark.sparkContext.broadcast(np.array(sorted(best_fit(counts, size)), np.int64).reshape(-1, 5))
    kept = [f.name for f in table.schema.fields if f.name not in ("task", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = rules.value
        keys = list(map(tuple, rule[:, :2].tolist()))
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = [bisect_right(keys, k) - 1 for k in zip(length.tolist(), rank.tolist())]
            _, first, sequence, each, offset = rule[at].T
            own = rank - first
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(sequence + own // np.maximum(each, 1)),
                 pa.array(offset + own % np.maximum(each, 1) * length)], [*kept, "sequence_id", "offset"])

    ranked = table.join(ranks, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
    ranked = ranked.select(*kept, (F.col("begin") + F.col("place")).alias("rank"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in kept)
    return ranked.mapInArrow(run, f"{types}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID,
         ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked
    for, ids of every piece."""
    out = placed(written(pieces(docs, path, size, end_id, ids), "best-fit"), size)
    return out if ids else out.drop("ids")
