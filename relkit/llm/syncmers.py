"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer when its smallest inner s-mer, by
hash, lies at its first or last place.  Whether it is one depends on its own
letters alone, so an edit changes the anchors it touches and no others.  Of equal
s-mers the leftmost is the smallest.  A fingerprint keeps every anchor, in text
order, each as ``hash@place``: about 2 in K - S + 1 places, so it grows with the
text.  Where one k-mer is the next anchor again and again (a line of dashes, a
word repeated), the run is one anchor, ``hash@place*count`` with its first place.

Likeness matches two fingerprints by place: the longest chain of anchors that
stand in the same order in both texts, as a share j of the anchors of both (those
of the chain counted once), becomes 2 j / (1 + j), about the share of text in
common.  A run counts once, whatever its length.

Neighbours: a narrow pass over (doc_id, text hash) cuts the order of all documents
into ranges; the first document of each range also goes to the end of the range
before it.  So one shuffle of the texts brings every document together with the one
behind it, and nothing else is written.

Rules: null text is empty.  The fingerprint of an empty text is empty; two empty
texts have likeness 1, an empty and another 0.  A text below k code points, or
without a syncmer, has one anchor.  Equal texts have equal fingerprints, and
likeness 1.  Next documents go by descending doc_id (null last), then by text
hash; after the last comes the first, and a lone document follows itself.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import pick, ready

K, S = 64, 8
#: Places of a long text that are hashed together.
STRETCH = 1 << 20
_A = 0x9E3779B97F4A7C15  # multiplier of the rolling hash
_M = (1 << 64) - 1
_POW = {n: np.uint64(pow(_A, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hash of a string from those of its two parts, the second n long."""
    return a * _POW[n] + b


def syncmers(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(places, hashes) of the closed syncmers of at least K code points, and the
    place and hash of the k-mer with the smallest s-mer."""
    h1 = _mixed(code.astype(np.uint64) + np.uint64(_A))
    h2 = _joined(h1[:-1], h1[1:], 1)
    h4 = _joined(h2[:-2], h2[2:], 2)
    h8 = _joined(h4[:-4], h4[4:], 4)
    order = _mixed(h8)
    low = np.minimum(order[:-1], order[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    low = np.minimum(low[:-8], low[8:])
    low = np.minimum(low[:-16], low[16:])      # over 32 s-mers
    before = np.minimum(low[:-24], low[24:])   # over the 56 before the last of a k-mer
    low = np.minimum(low[:-25], low[25:])      # over the 57 of a k-mer
    n = len(low)
    at = np.flatnonzero((order[:n] == low) | (order[K - S:] < before[:n]))
    least = int(low.argmin())
    h16 = _joined(h8[:-8], h8[8:], 8)
    h32 = _joined(h16[:-16], h16[16:], 16)
    hashes = _mixed(_joined(h32[:n], h32[32:], 32)[[*at, least]]) >> np.uint64(24)
    return at, hashes[:-1], least, int(hashes[-1])


def anchors(text: str) -> list[tuple[int, int, int]]:
    """(place, 40-bit hash, count) of the fingerprint, in text order."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < K:
        whole = 0
        for x in _mixed(code.astype(np.uint64) + np.uint64(_A)).tolist():
            whole = (whole * _A + x) & _M
        return [(0, int(_mixed(np.array([whole], np.uint64))[0] >> np.uint64(24)), 1)]
    out: list[tuple[int, int, int]] = []
    lone = None
    for start in range(0, len(code) - K + 1, STRETCH):
        at, hashes, least, hash_of = syncmers(code[start:start + STRETCH + K - 1])
        lone = lone or (start + least, hash_of, 1)
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        runs = zip((start + at[first]).tolist(), hashes[first].tolist(), np.diff([*first, len(at)]).tolist())
        for place, h, count in runs:
            if out and out[-1][1] == h:  # a run that goes on from the stretch before
                out[-1] = (out[-1][0], h, out[-1][2] + count)
            else:
                out.append((place, h, count))
    return out or [lone]


def fingerprint(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{h:010x}@{p}" if n == 1 else f"{h:010x}@{p}*{n}" for p, h, n in found)


def likeness(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    j = chain([h for _, h, _ in a], [h for _, h, _ in b])
    return 2 * j / (len(a) + len(b))  # of 2 j / (1 + j), j as a share of the union


def chain(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start:len(x) - end], y[start:len(y) - end]
    places: dict[int, list[int]] = {}
    for i, h in enumerate(x):
        places.setdefault(h, []).append(i)
    bits = {}
    for h in places.keys() & set(y):
        row = bytearray(len(x) // 8 + 1)
        for i in places[h]:
            row[i >> 3] |= 1 << (i & 7)
        bits[h] = int.from_bytes(row, "little")
    full = (1 << len(x)) - 1
    v = full
    for h in y:
        if h in bits:
            u = v & bits[h]
            v = (v + u | v - u) & full
    return start + end + len(x) - v.bit_count()


def edited(text: str, after: str) -> str:
    """The last half replaced by as much of the beginning of the next text."""
    n = len(text) // 2
    return text[:len(text) - n] + after[:n]


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
NAMES = [c.split()[0] for c in OUT.split(", ")]
def _row(doc_id, text: str, own, after: str, theirs) -> tuple:
    new = edited(text, after)
    marks = anchors(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            fingerprint(own), fingerprint(marks), likeness(own, marks), likeness(own, theirs))


def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one behind it; the last row of a range is the first
    document of the next one and is only looked at."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    for b in batches:
        out = []
        for doc_id, text, ends in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ends"))):
            text = text or ""
            own = anchors(text)
            if last is not None:
                out.append(_row(*last, text, own))
            last = None if ends else (doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], NAMES)


def place_of(key: Column, starts: list, low: int = 0, high: int | None = None) -> Column:
    """2 * range + 1 for the first row of a range, 2 * range for others, by halving:
    ``starts`` are the ranges' first keys in order."""
    high = len(starts) - 1 if high is None else high
    if low == high:
        return F.lit(2 * low) + (key == starts[low]).cast("int")
    middle = (low + high + 1) // 2
    return F.when(key < starts[middle], place_of(key, starts, low, middle - 1)).otherwise(
        place_of(key, starts, middle, high))


def fingerprints(docs: DataFrame) -> DataFrame:
    """OUT for every row of ``docs``: one shuffle of the texts."""
    spark = docs.sparkSession
    ready(spark)
    d = pick(docs, doc_id="bigint", text="string").withColumn("tie", F.monotonically_increasing_id())
    # ascending: ids from the largest down, null last; the tie splits a row that repeats
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"),
                   F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "tie")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = d.select(key.alias("key")).repartitionByRange(n, "key")
    starts = [r.key for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).collect()]
    if not starts:
        return d.select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", ")]).limit(0)
    starts = [F.struct(F.lit(k.none).alias("none"), F.lit(k.down).cast("bigint").alias("down"),
                       F.lit(k.h).cast("bigint").alias("h"), F.lit(k.tie).cast("bigint").alias("tie"))
              for k in sorted(starts)]
    d = d.select("doc_id", "text", key.alias("key")).withColumn("place", place_of(F.col("key"), starts))
    part = F.floor(F.col("place") / 2).cast("int")
    here = F.struct(part.alias("part"), F.lit(False).alias("ends"))
    before = F.struct(((part + len(starts) - 1) % len(starts)).alias("part"), F.lit(True).alias("ends"))
    rows = d.select("doc_id", "text", "key", F.inline(F.when(F.col("place") % 2 == 1, F.array(here, before))
                                                      .otherwise(F.array(here))))
    rows = rows.repartitionById(len(starts), "part").sortWithinPartitions("part", "ends", "key")
    return rows.select("doc_id", "text", "ends").mapInArrow(along, OUT)
