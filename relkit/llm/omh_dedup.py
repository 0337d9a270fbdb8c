"""Near-duplicates by order min-hash and banded alignment.

Sketch: the k-mers of K words of a text, each labelled with its occurrence
number, are hashed; a sketch takes the ELL smallest hashes of one hash function
and keeps them in text order, so texts share it when they share the k-mers and
their order, as texts of small edit distance do.  SKETCHES functions give as
many buckets a text.  With K = 3 and scattered changes they find a pair at the
threshold of 0.8 in 99 % of cases and more (README).

Short texts are exact: one of at most EXACT words has a bucket for each of its
k-mers.  d edits change at most 3 d of the n - 2 k-mers of the longer text, and
d <= n / 5 leaves one in common from six words on; five words and their partners
of four share a pair of words, which texts of so many words have as keys too.
Texts above SIMILAR * EXACT words have the sketches, so that a pair has either
the one or the other in common.

Candidates: buckets of one text are dropped once and for all.  In rounds, each text
of the buckets of more than SMALL texts meets up to HUBS hubs of other classes: of the
buckets' first and last texts, in a new order each round, those that it shares most
buckets with.  New links extend the classes so far, a bucket that has become one class
is left out, and the rounds end when one links no more than YIELD of the pairs it
aligns, or after ROUNDS.  In the buckets that then hold several classes every pair of two classes is
tested, small buckets as they are and larger ones in blocks of at most BLOCK texts.
Lengths and counts of hashed words, two lower bounds of the edit distance, exclude
pairs before any words are moved; all others are candidates, aligned in SHARES, so
that a large family of variants becomes one class before most of its pairs come up.
So any two texts of one bucket are in one class, aligned, or proved unlike.  The texts that share a bucket lie in buckets of their
rid, so that rounds shuffle pairs, with the words or counts of one end, and never all texts.

Verification: every candidate pair is aligned word by word in the band that the
similarity allows (bit-parallel, a band a column); similarity is 1 - edit
distance / words of the longer text, and 0.8 or more is a link.  Classes are the
connected components of all links, found by large-star / small-star rounds.  Pairs within
a class are not all aligned, so links are not counted.

Rules: words are runs of letters, digits and _ in lower case; a text without
any counts its blank-separated runs.  Texts of equal words are copies of one
class, also empty and null ones among themselves; texts below K words have one
k-mer, all their words.  In a class the smallest doc_id stays (null last, then
the first row read).  Repeated rows are copies.  An empty table gives an empty
result; other columns are ignored.  No row, bucket or text is cut short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import bucketed, dealt, pick, ready, rows_of, with_row, written

K, ELL, SKETCHES, SIMILAR, EXACT = 3, 2, 64, 0.8, 30
#: Rounds end when no more than this share of the pairs they align is linked.
YIELD = 0.03
#: Texts of a bucket that one task compares with one another, and counters of a text.
BLOCK, COUNTERS = 1024, 512
#: Texts of a bucket whose pairs are listed without hubs.
SMALL = 3
#: Hubs that a text meets in a round, and rounds at most; all that they leave open is tested after them.
HUBS, ROUNDS = 8, 4
#: The last pairs are aligned in shares that end at these sixteenths.
SHARES = (1, 4, 16)
REMEMBERED = 1_000_000
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(2)
FACTORS = _rng.integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LAST = np.uint64((1 << 64) - 1)
SHIFTS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) or text.split()


def kmers(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers, each with its occurrence number."""
    if len(ids) <= k:
        h = np.zeros(1, np.uint64)
        for x in ids:
            h = _mixed(h + x)
        return h
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        h = _mixed(h + ids[i:len(ids) - k + 1 + i])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        at = np.arange(len(s))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        h = _mixed(h + occurrence * np.uint64(0x9E3779B97F4A7C15))
    return h


def sketch(h: np.ndarray) -> np.ndarray:
    """Bucket key of each hash function, from the ELL smallest k-mers in text order."""
    key = SHIFTS.copy()
    take = min(ELL, len(h))
    some = max(8, 100_000 // len(h))  # functions at a time: a long text takes 8 rows of memory
    for i in range(0, SKETCHES, some):
        every = (h[None, :] ^ SHIFTS[i:i + some, None]) * FACTORS[i:i + some, None]
        every ^= every >> np.uint64(32)
        row, at = np.arange(len(every)), []
        for _ in range(take):
            at.append(every.argmin(axis=1))
            every[row, at[-1]] = LAST
        for j in np.sort(at, axis=0):  # text order
            key[i:i + some] = _mixed(key[i:i + some] + h[j])
    return key.view(np.int64)


def bucket_keys(ids: np.ndarray) -> np.ndarray:
    """Below four words only equal texts are similar: no bucket."""
    h, keys = kmers(ids), []
    if 4 <= len(ids) <= EXACT:
        keys.append(_mixed(h).view(np.int64))
    if 4 <= len(ids) <= 5:
        keys.append(_mixed(kmers(ids, 2) + np.uint64(2)).view(np.int64))
    if len(ids) > SIMILAR * EXACT:
        keys.append(sketch(h))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def counted(ids: np.ndarray) -> bytes:
    """Words by the low bits of their hash, up to 255 of each."""
    return np.minimum(np.bincount(ids & np.uint64(COUNTERS - 1), minlength=COUNTERS), 255).astype(np.uint8).tobytes()


def edit_distance(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edit distance if it is at most ``most``, else a larger number.

    Column by column, the cells within ``most`` of the diagonal are one band of
    bits (vertical differences +1 and -1); the band slides down by a row with
    each column.  Rows above the first hold falling values, which give the first
    row its counts.  The result is summed along the diagonal of the last cell,
    where values never fall, so it ends as soon as it exceeds ``most``."""
    m, n = len(x), len(y)
    if abs(m - n) > most:
        return most + 1
    place: dict[int, int] = {}
    for i, t in enumerate(x.tolist()):
        place[t] = place.get(t, 0) | 1 << i
    band = (1 << (2 * most + 1)) - 1
    goal = most + m - n
    up, down = band >> most << most, band >> (most + 1)
    distance = abs(m - n)
    for j, t in enumerate(y.tolist()):
        p = place.get(t, 0)
        same = (p >> (j - most) if j >= most else p << (most - j)) & band
        level = ((((same & up) + up) ^ up) | same | down) & band
        right = down | band & ~(level | up)
        left = level & up
        if not level >> goal & 1:
            distance += 1
            if distance > most:
                return distance
        up = (left | ~(level >> 1 | right)) & band
        down = level >> 1 & right
    return distance


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """1 - edit distance / words of the longer text, or 0 below SIMILAR."""
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    most = int((1 - SIMILAR) * longer + 1e-9)
    d = edit_distance(x, y, most)
    return 1 - d / longer if d <= most else 0.0


READ = "digest string, n_words int, words binary, counts binary"


def reader():
    """Column function text -> struct of READ."""
    @F.pandas_udf(READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts.fillna(""):
                w = words(t)
                if len(seen) > REMEMBERED:
                    seen = {}
                ids = list(map(seen.get, w))
                if None in ids:
                    for i, x in enumerate(ids):
                        if x is None:
                            ids[i] = seen[w[i]] = xxhash.xxh3_64_intdigest(w[i])
                ids = np.array(ids, np.uint64)
                raw = ids.astype("<u8").tobytes()
                out.append((xxhash.xxh3_128_hexdigest(raw), len(ids), ids.astype("<u4").tobytes(), counted(ids)))
            yield pd.DataFrame(out, columns=["digest", "n_words", "words", "counts"])

    return read


def shared_keys(table: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, rep) of the buckets that hold several texts, made once.

    The keys of a text are computed from its words where the text is read, once a
    task for copies, and travel as (key, short digest); a task that has them by key
    keeps those it meets with several texts, looking at one row after the other.
    Only what is left is joined with the texts' ids."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            of, short = [], []
            for digest, raw in zip(b.column("digest").to_pylist(), b.column("words").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    of.append(bucket_keys(_mixed(np.frombuffer(raw, "<u4").astype(np.uint64))))
                    short.append(int(digest[:16], 16))
            n = [len(k) for k in of]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(of)), pa.array(np.repeat(np.array(short, np.uint64).view(np.int64), n))],
                    ["key", "text"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, False  # the row before this batch, and whether it went out
        for b in batches:
            key, text = (b.column(c).to_numpy() for c in ("key", "text"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            if len(key) and last is not None:
                new[0] = (key[0], text[0]) != last
            key, text = key[new], text[new]
            if not len(key):
                continue
            same = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
            keep = same.copy()
            keep[:-1] |= same[1:]
            before = np.array([last] if same[0] and not kept else [], np.int64).reshape(-1, 2)
            out = np.concatenate([before[:, 0], key[keep]]), np.concatenate([before[:, 1], text[keep]])
            last, kept = (key[-1], text[-1]), bool(keep[-1])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["key", "text"])

    flat = table.select("digest", "words").mapInArrow(keys, "key bigint, text bigint")
    flat = flat.repartition("key").sortWithinPartitions("key", "text").mapInArrow(several, "key bigint, text bigint")
    text = F.conv(F.substring("digest", 1, 16), 16, -10).cast("bigint")
    return written(written(flat, "omh-keys").join(reps.select(text.alias("text"), "rep"), "text").select("key", "rep"),
                   "omh-buckets")


def open_buckets(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, n, rep, root) of the buckets that hold several classes."""
    flat = keys.join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "key")
    several = (flat.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"),
                                       F.max("root").alias("high"))
               .where("low != high").select("key", "n"))
    return flat.join(several, "key")


def met(members: DataFrame, turn: int) -> DataFrame:
    """(a, b), a < b: each text with up to HUBS hubs.  The hubs of a bucket are its first
    and last text in the order of this turn; a text meets, of the hubs of its buckets
    that are of another class, those that it shares most of them with."""
    at = F.struct(F.xxhash64(F.lit(turn), "rep").alias("o"), "rep", "root")
    hubs = members.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    near = members.join(hubs, "key").select("rep", "root", F.explode(F.array("first", "last")).alias("c"))
    shared = (near.where(F.col("root") != F.col("c.root")).groupBy("rep", F.col("c.rep").alias("hub"))
              .agg(F.count(F.lit(1)).alias("n")))
    ranked = F.sort_array(F.collect_list(F.struct("n", "hub")), False)  # at most two a key of the text
    best = shared.groupBy("rep").agg(F.slice(ranked, 1, HUBS).alias("best")).select("rep", F.explode("best.hub").alias("hub"))
    return best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def whole(members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of two classes of the buckets of up to SMALL texts."""
    m = (members.where(F.col("n") <= SMALL).groupBy("key")
         .agg(F.sort_array(F.collect_list(F.struct("rep", "root"))).alias("m")))  # at most SMALL
    two = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, SMALL), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"),
                                                       (x["root"] != y["root"]).alias("other")))))
    return m.select(F.explode(two).alias("p")).where("p.other").select("p.a", "p.b").distinct()


def likely(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, like): whether lengths and counts leave a link possible, so that only
    the words of such pairs are moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16)
                    for c in ("ca", "cb"))
            longer, d = np.maximum(n, m), x - y
            least = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
            like = np.maximum(least, np.abs(n - m)) <= ((1 - SIMILAR) * longer + 1e-9).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like)], ["a", "b", "like"])

    def end(c: str) -> DataFrame:
        return table.select(F.col("rid").alias(c), F.col("n_words").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))

    # the pairs are dealt out; the texts stay in their buckets, which are hashed, so that a
    # hub's many pairs stream by
    both = pairs.join(end("a").hint("shuffle_hash"), "a").join(end("b").hint("shuffle_hash"), "b")
    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a bigint, b bigint, like boolean")


def unlike(n: np.ndarray, counts: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Whether text ``i`` is certainly no link of each of ``others``."""
    longer = np.maximum(n[others], n[i])
    most = ((1 - SIMILAR) * longer + 1e-9).astype(np.int64)
    out = longer - np.minimum(n[others], n[i]) > most
    near = np.flatnonzero(~out)
    d = counts[others[near]] - counts[i]
    out[near] = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)) > most[near]
    return out


def marks(lists: pa.ListArray) -> np.ndarray:
    """A row of bits for each list, one for each value that several lists hold."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    _, value, n = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = n[value] > 1
    owner, at = owner[several], (np.cumsum(n > 1) - 1)[value[several]]
    out = np.zeros((len(lists), (n > 1).sum() // 8 + 1), np.uint8)
    np.bitwise_or.at(out, (owner, at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
    return out


def rest(members: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of a larger bucket that are of two classes and not unlike.
    Variants share many buckets: a pair goes out of the one with the smallest key only, for
    which each text brings its smaller keys along."""
    members = members.where(F.col("n") > SMALL)
    every = members.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # at most those of a text
    share = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), share).cast("int")
    m = members.select("key", "rep", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), share - 1)).alias("j"))
    m = m.select("key", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own", "rep", "root")
    m = m.join(table.select(F.col("rid").alias("rep"), "n_words", "counts"), "rep").join(every, "rep")
    m = m.withColumn("lower", F.filter("keys", lambda k: k < F.col("key")))
    cells = (m.groupBy("key", "i", "j").agg(
        F.collect_list(F.struct("rep", "root", "own", "n_words", "counts", "lower")).alias("m"),
        F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            for at in range(len(lists)):
                cell = lists[at].values
                rep, root, own, n = (cell.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                     for c in ("rep", "root", "own", "n_words"))
                counts = np.frombuffer(b"".join(cell.field("counts").to_pylist()), np.uint8)
                counts = counts.reshape(len(rep), COUNTERS).astype(np.int16)
                two = own.min() != own.max()  # texts of one block meet in their own cell
                held = None
                for i in range(len(rep)):
                    later = np.flatnonzero((root[i + 1:] != root[i]) & ((own[i + 1:] != own[i]) | (not two))) + i + 1
                    later = later[~unlike(n, counts, i, later)]
                    if len(later):
                        held = marks(cell.field("lower")) if held is None else held
                        later = later[~(held[later] & held[i]).any(axis=1)]
                    if len(later):
                        pair = np.minimum(rep[later], rep[i]), np.maximum(rep[later], rep[i])
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, pair)), ["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the linked pairs; ``texts`` is (rep, words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(f.x, f.y)]
            f = f[["a", "b"]].assign(similarity=s)
            yield f[f.similarity > 0]

    # as in ``likely``: of the texts, only the first ones of the pairs are moved
    first, second = (texts.select(F.col("rep").alias(c), F.col("words").alias(w)).hint("shuffle_hash")
                     for c, w in (("a", "x"), ("b", "y")))
    both = pairs.join(first, "a").join(second, "b")
    return both.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(rep, root) of all nodes of (a, b): alternating large-star and small-star
    rounds, until all that is left are stars around their smallest node.  Each
    round is cut by a reliable checkpoint; only a count comes to the driver."""
    def star(e: DataFrame, small: bool) -> DataFrame:
        if not small:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = e.join(low, "u")
        if not small:
            return j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        edges = star(star(edges, False), True).where("u != v").distinct().checkpoint()
        # done when each node has one edge to a root that has none: edges point to the smaller end
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                              F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
        nodes = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("low"))
        if not nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("low") == 0))).agg(F.count(F.lit(1))).first()[0]:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: only the classes that these touch are worked out
    anew, between their roots."""
    def root_of(c: str) -> DataFrame:
        return roots.select(F.col("rep").alias(c), F.col("root").alias(f"root_{c}"))

    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(between)
    moved = roots.join(new.select(F.col("rep").alias("root"), F.col("root").alias("to")), "root", "left")
    return moved.select("rep", F.coalesce("to", "root").alias("root")).unionByName(new)


def extended(roots: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``roots`` after the links of ``pairs``, share by share: pairs whose texts the
    shares before have brought into one class are not aligned any more."""
    def root_of(c: str) -> DataFrame:
        return roots.select(F.col("rep").alias(c), F.col("root").alias(f"root_{c}"))

    share = F.pmod(F.xxhash64("a", "b"), F.lit(SHARES[-1]))
    for low, high in zip((0, *SHARES), SHARES):
        some = pairs.where((share >= low) & (share < high)).join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
        some = some.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        links = written(verified(written(some, "omh-share"), texts), "omh-links")
        roots = written(merged(roots, links), "omh-roots")
    return roots


def linked(keys: DataFrame, table: DataFrame) -> DataFrame:
    """(rep, root) of all texts that have a link, from the shared keys."""
    # every round joins pairs with their texts: these lie in buckets of rid, so that only pairs are shuffled
    some = dealt(table.select("rid", "n_words", "counts", "words"), "rid")
    table = bucketed(some.join(keys.select(F.col("rep").alias("rid")).distinct(), "rid", "left_semi"), "rid", "omh-table")
    texts = table.select(F.col("rid").alias("rep"), "words")
    roots, turn, more = keys.select("rep", F.col("rep").alias("root")).limit(0), 0, True
    while True:
        # a bucket that has become a single class is not looked at again
        members = written(open_buckets(keys, roots), f"omh-open{turn}")
        if not more:
            pairs = likely(whole(members), table).where("like").select("a", "b").unionByName(rest(members, table))
            return extended(roots, written(pairs.distinct(), "omh-rest"), texts)
        keys = members.select("key", "rep")
        pairs = written(likely(met(members.where(F.col("n") > SMALL), turn), table), f"omh-pairs{turn}")
        new = written(verified(pairs.where("like").select("a", "b"), texts), f"omh-links{turn}")
        more = turn + 1 < ROUNDS and new.count() > YIELD * pairs.where("like").count()
        roots, turn = written(merged(roots, new), f"omh-roots{turn}"), turn + 1


def classed(docs: DataFrame, rows: bool = False) -> DataFrame:
    """rid, doc_id, class_id, class_size, kept (and row) for every row."""
    ready(docs.sparkSession)
    d = with_row(docs, doc_id="bigint", text="string") if rows else pick(docs, doc_id="bigint", text="string")
    d = d.select(F.monotonically_increasing_id().alias("rid"), *["row"] * rows, "doc_id", reader()("text").alias("r"))
    table = written(d.select("rid", *["row"] * rows, "doc_id", "r.*"), "omh")
    # copies: one text a digest goes on
    reps = written(table.groupBy("digest").agg(F.min("rid").alias("rep")), "omh-texts")
    roots = linked(shared_keys(table, reps), table)
    known = reps.select("digest", "rep").join(roots, "rep", "left").select("digest",
                                                                           F.coalesce("root", "rep").alias("root"))
    member = table.select("rid", "doc_id", "digest").join(known, "digest")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid"))
    top = member.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    out = member.join(top, "root").select(
        "rid", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"))
    return out.join(table.select("rid", "row"), "rid") if rows else out


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept."""
    return classed(docs).drop("rid")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return rows_of(classed(docs, rows=True).where("kept"), docs.columns)
