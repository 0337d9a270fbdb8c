"""Packing by concatenate and cut.

First pass: every task tokenizes its documents once, writes the ids with their
place in the task's own stream, and thereby the task's token total.  The totals
(one number a task) are summed up to global offsets.  Second pass: a document's
global offset is its task's offset plus its place; windows of ``size`` ids cut
the stream, and each document yields one record per window it touches, so a
document over a border is told by two records that name its start and place.

The only padding is that of the last sequence.  Rules: null or empty text is
the end id alone; ids of any text are whole (nothing is truncated) and those of the
tokenizer as it comes, so a special token spelled out in a text is its one id; repeated
rows are packed as often as they come; an empty table packs to nothing; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relkit.llm.common import pick, ready, written

SIZE = 2048
END_ID = 1
#: Chunks whose ids a worker remembers before it starts anew.
REMEMBERED = 1_500_000

#: The vocabulary's own splitter (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks of these go piece by piece, any other chunk is encoded whole: up to
#: U+024F composition and lower case change nothing that Python's don't.
PLAIN = regex.compile(r"[!-;=-~À-ÖØ-öø-įı-ɏ]+")
MARKS = frozenset(".,;:!?")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts by ``tokenizers``, remembering chunks between blanks.

    The vocabulary splits at blanks and drops them, so a text's ids are those of
    its chunks in a row; new chunks of a batch are encoded together, and what
    belongs to which chunk is told by the word-end mark of the last id of each
    piece.  Ids fit 16 bits (the vocabulary has 49,408)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        # for pieces that are split and in lower case already
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        flat = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(new) or ends[-1] != len(flat):
            self.pieces.update((p, self._whole(p)) for p in new)
            return
        raw, start = flat.astype("<u2").tobytes(), 0
        for p, e in zip(new, ends.tolist()):
            self.pieces[p] = raw[2 * start:2 * e]
            start = e

    def _learn(self, new: set[str]) -> None:
        split = {}
        for c in new:
            low = c.lower()
            if low.isascii() or PLAIN.fullmatch(c):
                if low.isalpha():
                    split[c] = (low,)
                elif low[-1] in MARKS and low[:-1].isalpha():
                    split[c] = (low[:-1], low[-1])
                elif PLAIN.fullmatch(c):
                    split[c] = PIECES.findall(low)
                else:
                    self.chunks[c] = self._whole(c)
            else:
                self.chunks[c] = self._whole(c)
        fresh = list({p for parts in split.values() for p in parts}.difference(self.pieces))
        for i in range(0, len(fresh), 2000):
            self._learn_pieces(fresh[i:i + 2000])
        get = self.pieces.__getitem__
        for c, parts in split.items():
            self.chunks[c] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        if len(self.chunks) > REMEMBERED:
            self.chunks, self.pieces = {"": b""}, {}
        get, out, new = self.chunks.get, [], set()
        for t in texts:
            c = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            ids = list(map(get, c))
            late = [(i, c[i]) for i, x in enumerate(ids) if x is None] if None in ids else ()
            new.update(x for _, x in late)
            out.append((ids, late))
        if new:
            self._learn(new)
        for ids, late in out:
            for i, x in late:
                ids[i] = self.chunks[x]
        return [b"".join(ids) for ids, _ in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


STREAM = "doc_id bigint, task bigint, place bigint, n bigint, ids binary"


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, task, place, n, ids): ``place`` is the number of ids before the
    document in its task's stream; ``ids`` are little-endian, 16 bits each."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, place = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [x + end for x in enc.encode([t or "" for t in b.column("text").to_pylist()])]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            begin = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), task)), pa.array(begin), pa.array(n),
                 pa.array(ids, pa.binary())], ["doc_id", "task", "place", "n", "ids"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, STREAM)


PIECE = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
         "sequence_id bigint, offset bigint")


def cut(stream: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces of (doc_id, at, n, ids), ``at`` being the global offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, at, n, raw in zip(f.doc_id.astype("Int64"), f["at"], f.n, f.ids):
                wide, start = np.frombuffer(raw, "<u2").astype("<u4").tobytes(), 0
                while start < n:
                    offset = (at + start) % size
                    length = min(size - offset, n - start)
                    out.append((doc_id, start, length, zlib.crc32(wide[4 * start:4 * (start + length)]), n,
                                (at + start) // size, offset))
                    start += length
            got = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
            yield got.astype({"doc_id": "Int64"})

    return stream.select("doc_id", "at", "n", "ids").mapInPandas(run, PIECE)


def offsets(stream: DataFrame) -> DataFrame:
    """(task, begin): ids before each task's first, from one total a task."""
    totals = stream.groupBy("task").agg(F.sum("n").alias("total"))
    return totals.select("task", (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("begin"))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    ready(docs.sparkSession)
    stream = written(tokenized(docs, path or vocabulary()), "pack")
    return cut(stream.join(offsets(stream), "task").withColumn("at", F.col("begin") + F.col("place")), size)
