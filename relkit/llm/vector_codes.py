"""Vector compression by product codes with equal-average search.

Vectors become integers floor(SCALE * x) and are cut into PARTS equal consecutive
parts, each with its own codebook.  A codebook starts as the parts of the ENTRIES
smallest ids and is improved in ROUNDS rounds: each task finds the nearest entry
of its parts and sums them by entry, Spark adds up the sums of all tasks (as many
rows as codebooks have components, whatever the table), and every entry becomes
the floor of its parts' mean.

Equal-average search: entries are sorted by the sum of their components.  Since
(sum of x - sum of e)^2 / dimension never exceeds the squared distance of x and e,
the search goes outward from the sum of x, up and down, and a direction ends once
its squared gap over the dimension strictly exceeds the best distance, so entries
at equal distance are all seen and the lowest index wins.  Parts of near sums take
their steps together, a block of entries a step; a part that has ended drops out.

All of it is exact: the number type is chosen from the largest component, up to
Python's own integers, and sums travel as 32-bit digits where 64 bits might not
hold them.

Rules: rows whose vector is null or holds a null, NaN or infinity are dropped.
Shorter vectors than the longest, and a length that PARTS does not divide, are
filled up with zeros; vectors without a component have code 0 and error 0.  Fewer
than ENTRIES vectors give as many entries.  Of equal ids (null last) the smaller
vector comes first; repeated rows count as often as they come.  Errors beyond a
long are the largest long.  An empty table gives an empty result; other columns
are ignored.  The table is read once a round, so it should be a stored one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relkit.llm.common import ready, with_row, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that search together, entries of a step, and groups of tasks that look for the smallest ids.
TOGETHER, BLOCK, GROUPS = 256, 16, 1024
LONGEST = (1 << 63) - 1
DIGIT = 32


def kept(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, v, label) of the rows with a finite vector."""
    at = next((f.dataType for f in vectors.schema.fields if f.name == vector), None)
    kind = at.simpleString() if at is not None and at.typeName() == "array" else "array<double>"
    d = with_row(vectors, **{vec_id: "bigint", vector: kind, label: "string"})
    d = d.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
                                              F.lit(False)))
    return d.where(F.col("v").isNotNull() & fine)


def whole(lists: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    """floor(SCALE * x) of each vector, with zeros up to ``dim``."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    if kind == object:
        ints = np.array([int(x) * SCALE if abs(x) >= 1 << 60 else int(np.floor(x * SCALE)) for x in flat.tolist()],
                        object)
    else:
        ints = np.floor(flat.astype(np.float64) * SCALE).astype(kind)
    if (n == dim).all():
        return ints.reshape(len(n), dim)
    out = np.zeros((len(n), dim), kind)
    out[np.arange(dim)[None, :] < n[:, None]] = ints
    return out


class Book:
    """The entries of one part, sorted by their sums, in blocks of BLOCK; within a
    block they stand by index, so that the first of equal distances is the lowest."""

    def __init__(self, entries: np.ndarray):
        self.dim = entries.shape[1]
        sums = entries.sum(axis=1)
        order, self.blocks = np.argsort(sums, kind="stable"), []
        for i in range(0, len(order), BLOCK):
            at = np.sort(order[i:i + BLOCK])
            e = entries[at]
            self.blocks.append((at, 2 * e.T, (e * e).sum(axis=1), sums[at].min(), sums[at].max()))
        self.lows = np.array([b[3] for b in self.blocks])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        if self.dim:
            own = x.sum(axis=1)
            order = np.argsort(own, kind="stable")
            for i in range(0, len(x), TOGETHER):  # rows of near sums go together
                rows = order[i:i + TOGETHER]
                index[rows], best[rows] = self.outward(x[rows], own[rows])
        return index, best

    def outward(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own2, start = (x * x).sum(axis=1), max(0, int(np.searchsorted(self.lows, own[len(own) // 2], "right")) - 1)
        index, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)
        # (rows still searching, next block, step) upward and downward
        ways = [(np.arange(len(x)), start, 1), (np.arange(len(x)), start - 1, -1)]
        while ways:
            after = []
            for rows, at, step in ways:
                if not 0 <= at < len(self.blocks):
                    continue
                entry, twice, far, low, high = self.blocks[at]
                gap = np.maximum(low - own[rows] if step > 0 else own[rows] - high, 0)
                rows = rows[(gap * gap <= best[rows] * self.dim) | (index[rows] < 0)]
                if not len(rows):
                    continue
                d = far - x[rows] @ twice
                first = d.argmin(axis=1)
                d, e = d[np.arange(len(rows)), first] + own2[rows], entry[first]
                better = (index[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                rows_better = rows[better]
                best[rows_better], index[rows_better] = d[better], e[better]
                after.append((rows, at + step, step))
            ways = after
        return index, best


def kind_of(most: int, dim: int) -> np.dtype:
    """A number type that holds every squared distance and squared gap exactly."""
    span = 4 * (2 * most) ** 2 * max(1, dim) ** 2
    return np.dtype(np.float64 if span < 1 << 53 else np.int64 if span < 1 << 63 else object)


def found(books: list[Book], lists: pa.Array, dim: int, kind: np.dtype):
    """(part, its components, index, distance) of the parts of a batch."""
    x = whole(lists, dim, kind)
    width = dim // len(books)
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
        yield p, part, *book.nearest(part)


def digits(sums: np.ndarray, n: int) -> list[int]:
    """Each number as n digits of 32 bits, lowest first, the last one signed."""
    if n == 1:
        return sums.tolist()
    return [v >> DIGIT * i & (1 << DIGIT) - 1 if i < n - 1 else v >> DIGIT * i
            for v in map(int, sums.tolist()) for i in range(n)]


def sums_of(vectors: DataFrame, codebooks: np.ndarray, dim: int, kind: np.dtype, n: int) -> DataFrame:
    """(part, entry, count, at, digit) summed over all tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        books = [Book(b) for b in entries]
        wide = object if kind == object else np.int64
        total, count = np.zeros(entries.shape, wide), np.zeros(entries.shape[:2], np.int64)
        for b in batches:
            for p, part, index, _ in found(books, b.column("v"), dim, kind):
                order = np.argsort(index, kind="stable")
                used, begin = np.unique(index[order], return_index=True)
                if part.size:
                    total[p][used] += np.add.reduceat(part[order].astype(wide), begin, axis=0)
                count[p] += np.bincount(index, minlength=len(count[p]))
        used = zip(*map(np.ndarray.tolist, count.nonzero()))
        rows = [(p, e, int(count[p, e]), digits(total[p, e], n)) for p, e in used]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "entry", "n", "sums"])

    part = vectors.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    each = part.select("part", "entry", "n", F.posexplode("sums").alias("at", "digit"))
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("digit").alias("digit"))


def improved(codebooks: np.ndarray, rows: list, n: int) -> np.ndarray:
    """Each used entry as the floor of its mean."""
    out, total = codebooks.copy(), {}
    for r in rows:
        key = r.part, r.entry, r["at"] // n
        count, before = total.get(key, (r.n, 0))
        total[key] = count, before + (r.digit << DIGIT * (r["at"] % n))
    for (p, e, j), (count, s) in total.items():
        out[p, e, j] = s // count  # exact integers, whatever type holds them
    return out


def first_books(vectors: DataFrame, dim: int, kind: np.dtype, entries: int) -> np.ndarray:
    """The parts of the smallest ids: the smallest of each task, then of each
    group of tasks, then of all."""
    by = Window.partitionBy("g").orderBy(F.asc_nulls_last("vec_id"), F.asc("v"))
    some = vectors.select("vec_id", "v", (F.spark_partition_id() % GROUPS).alias("g"))
    some = some.withColumn("r", F.row_number().over(by)).where(F.col("r") <= entries)
    rows = some.orderBy(F.asc_nulls_last("vec_id"), F.asc("v")).limit(entries).select("v").toArrow()
    x = whole(rows.column("v").combine_chunks(), dim, kind)
    return np.stack(np.split(x, PARTS, axis=1))


def trained(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int, np.dtype]:
    """Codebooks (part, entry, component), the padded dimension and number type
    of ``kept`` vectors."""
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), most.alias("most")).first()
    dim = -(-(size.dim or 0) // PARTS) * PARTS
    most = SCALE * (int(size.most or 0) + 1)
    kind = kind_of(most, dim // PARTS)
    n = 1 if most * size.n < 1 << 62 else -(-(most * size.n).bit_length() // DIGIT) + 1
    books = first_books(vectors, dim, kind, entries)
    for _ in range(rounds if size.n and dim else 0):
        books = improved(books, sums_of(vectors, books, dim, kind, n).collect(), n)
    return books, dim, kind


def coded(vectors: DataFrame, codebooks: np.ndarray, dim: int, kind: np.dtype) -> DataFrame:
    """(vec_id, label, code, error) of ``kept`` vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book(b) for b in shared.value]
        for b in batches:
            index, far = np.zeros((b.num_rows, PARTS), np.uint8), [0] * b.num_rows
            for p, _, i, d in found(books, b.column("v"), dim, kind):
                index[:, p] = i
                far = [f + int(g) for f, g in zip(far, d.tolist())]
            code = index.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"),
                 pa.array([code[i:i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string()),
                 pa.array([min(f, LONGEST) for f in far], pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, "vec_id bigint, label string, code string, error bigint")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    ready(vectors.sparkSession)
    vectors = kept(vectors, vec_id, vector, label).select("vec_id", "label", "v")
    books, dim, kind = trained(vectors)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel().tolist()).encode()).hexdigest()
    codes = written(coded(vectors, books, dim, kind), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.least(total, F.lit(LONGEST)).cast("bigint")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(width: int = 16) -> str:
    """DuckDB SQL of ``vector_codes`` over ``embeddings`` of PARTS * width
    components: every distance of every part to every entry."""
    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
    SELECT rid, p, arg_min(entry, dist * {ENTRIES} + entry) AS entry, min(dist) AS dist FROM (
        SELECT rid, part.p, entry, list_inner_product(part.c, part.c) + list_inner_product(b{r}.c, b{r}.c)
               - 2 * list_inner_product(part.c, b{r}.c) AS dist
        FROM part JOIN b{r} ON part.p = b{r}.p) GROUP BY rid, p)"""

    def improved(r: int) -> str:
        return f"""
m{r} AS MATERIALIZED (
    SELECT p, entry, list(floor(s / n) ORDER BY j) AS c FROM (
        SELECT p, entry, j, sum(c[j]) AS s, count(*) AS n
        FROM part JOIN a{r - 1} USING (rid, p), (SELECT unnest(range(1, {width} + 1)) AS j) GROUP BY p, entry, j)
    GROUP BY p, entry),
b{r} AS MATERIALIZED (
    SELECT p, entry, coalesce(m{r}.c, b{r - 1}.c) AS c FROM b{r - 1} LEFT JOIN m{r} USING (p, entry))"""

    rounds = ",".join(f"{improved(r)},{assigned(r)}" for r in range(1, ROUNDS + 1))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
           list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
    SELECT rid, p, e[p * {width} + 1:(p + 1) * {width}] AS c FROM v, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, rid AS entry, c FROM part WHERE rid < {ENTRIES}),{assigned(0)},{rounds},
codes AS MATERIALIZED (
    SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
    FROM a{ROUNDS} GROUP BY rid),
hash AS (
    SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ','
                  ORDER BY p, entry)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM hash) AS codebooks_sha256
FROM v JOIN codes USING (rid)
"""
