"""Mixing sources to target weights by Pareto order sampling (native).

Targets: the sources, in code-point order (null last), weigh 1, 2, 3, 1, 2, 3 …
and share the words of all documents; no target exceeds ``max_copies`` times
its source, the excess goes to the others by weight.  This is solved in closed
form over the per-source table (one row a source).

Sampling: a source with target r words per word gives floor(r) certain copies
of each document.  The rest is a sample without replacement in which a document
has inclusion probability p = r - floor(r), unequal between sources: documents
are ranked by (u / (1 - u)) / (p / (1 - p)) with u uniform from a hash of id and
text, and the smallest ranks are taken until their words fill what is left of
the target (size fixed in words; the last document goes in if at least half of
it fits).  Reruns agree, whatever the partitioning.

No rank needs the rows of a source in one task: words are first summed by
(source, bucket of u); only the one bucket that holds the cut is ordered, and a
row then compares its own rank with its source's cut.  As p is one number a
source, ranks order a source as u does: inside a source this is ordered uniform
sampling with equal probabilities.

Rules: null or blank text has size 0 and is never missed; null source is a
source of its own, last in order; rows that repeat in id, text and source are
taken or left together; empty table, empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relkit.llm.common import pick, rows_of, with_row, written

SEED = "mix-1"
BUCKETS = 4096
WEIGHTS = 3  # 1, 2, 3, repeating
MAX_COPIES = 3
BLANK = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``, without building the words: each word with
    the blanks behind it becomes one character, leading blanks are taken off."""
    t = F.coalesce(text, F.lit(""))
    short = F.regexp_replace(t, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    leading = F.length(t) - F.length(F.ltrim(t, F.lit(BLANK)))
    return (F.length(short) - leading).cast("bigint")


def keyed(d: DataFrame, *more: str) -> DataFrame:
    """(src, rank_key, u, size): src never null; rank_key orders like u."""
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"),
                            F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return (d.select(*more, "doc_id", words(F.col("text")).alias("size"),
                     F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("src"),
                     key.alias("rank_key"))
            .withColumn("u", (F.conv(F.substring("rank_key", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)))


def targets(totals: DataFrame) -> DataFrame:
    """(src, source_size, target) from (src, source_size): the water level at
    which caps and shares add up to all words.  One row a source."""
    every = Window.orderBy(F.col("src") == "n", "src")
    t = totals.withColumn("weight", (F.row_number().over(every) - 1) % WEIGHTS + 1)
    t = t.withColumn("cap", F.col("source_size") * MAX_COPIES).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "src")
    whole = Window.partitionBy()
    t = (t.withColumn("before", F.sum("cap").over(by) - F.col("cap"))
          .withColumn("left_w", F.sum("weight").over(whole) - F.sum("weight").over(by) + F.col("weight"))
          .withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("left_w")))
    # the first source, by ratio, whose share stays below its cap sets the level
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))
    t = t.withColumn("at", F.min(fits).over(whole))
    capped = F.struct("ratio", "src") < F.struct("at.ratio", "at.src")
    return t.select("src", "source_size",
                    F.when(capped, F.col("cap").cast("double"))
                     .otherwise(F.col("at.level") * F.col("weight")).alias("target"))


def rank(u: Column, p: Column) -> Column:
    """Pareto rank: odds of u by odds of the inclusion probability."""
    return (u / (1 - u)) / (p / (1 - p))


def plan(rows: DataFrame) -> DataFrame:
    """Per source: source_size, target, whole (certain copies), p, and ``cut_rank``
    and ``cut_key``, the last rank taken (null: no further copy)."""
    size = F.col("size")
    t = targets(rows.groupBy("src").agg(F.sum(size).alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = (t.withColumn("whole", F.least(F.floor(rate), F.lit(MAX_COPIES)).cast("bigint"))
          .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
          .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    # buckets of u order like the rank inside a source, where p is one number
    b = F.floor(F.col("u") * BUCKETS).alias("bucket")
    sums = rows.groupBy("src", b).agg(F.sum(size).alias("words"))
    run = Window.partitionBy("src").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
    # the cut lies in the last bucket that begins below the rest
    at = (sums.join(t.where("p > 0").select("src", "rest"), "src").where("before < rest")
          .groupBy("src").agg(F.max(F.struct("bucket", "before", "rest")).alias("at")))
    same = (rows.select("src", b, "rank_key", "u", "size").join(
                at.select("src", "at.*"), ["src", "bucket"])
            .groupBy("src", "before", "rest", "rank_key", "u").agg(F.sum("size").alias("words")))
    order = Window.partitionBy("src").orderBy("rank_key")
    last = (same.withColumn("begin", F.col("before") + F.sum("words").over(order) - F.col("words"))
            .where(F.col("begin") + F.col("words") / 2 <= F.col("rest"))
            .groupBy("src").agg(F.max(F.struct("rank_key", "u")).alias("last")))
    # nothing of the bucket fits: the cut is the bucket's lower edge
    edge = at.select("src", (F.col("at.bucket") / BUCKETS).alias("edge"))
    return (t.join(edge, "src", "left").join(last, "src", "left")
            .withColumn("cut_rank", rank(F.coalesce(F.col("last.u"), F.col("edge")), F.col("p")))
            .select("src", "source_size", "target", "whole", "p", "cut_rank",
                    F.coalesce(F.col("last.rank_key"), F.lit("")).alias("cut_key")))


def decided(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with source_size, target and copies."""
    j = rows.join(by_source, "src")
    mine = F.struct(rank(F.col("u"), F.col("p")).alias("r"), F.col("rank_key").alias("k"))
    cut = F.struct(F.col("cut_rank").alias("r"), F.col("cut_key").alias("k"))
    extra = F.when((F.col("p") > 0) & F.col("cut_rank").isNotNull() & (mine <= cut), 1).otherwise(0)
    return j.withColumn("copies", F.col("whole") + extra)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row."""
    rows = written(keyed(pick(docs, doc_id="bigint", text="string", source="string")), "mix")
    return decided(rows, plan(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns of ``docs``."""
    narrow = written(keyed(pick(docs, doc_id="bigint", text="string", source="string")), "mix")
    rows = keyed(with_row(docs, doc_id="bigint", text="string", source="string"), "row")
    out = decided(rows, plan(narrow)).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows_of(out, docs.columns)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
              (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {WEIGHTS} + 1 AS weight
       FROM d GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s0),
s2 AS (SELECT a.source, a.source_size, a.weight, a.cap, a.ratio,
              ((SELECT sum(source_size) FROM s1) - coalesce(sum(b.cap) FILTER (b.ratio < a.ratio), 0))::DOUBLE
              / ((SELECT sum(weight) FROM s1) - coalesce(sum(b.weight) FILTER (b.ratio < a.ratio), 0)) AS level
       FROM s1 a, s1 b GROUP BY ALL),
s3 AS (SELECT *, (SELECT min_by(level, ratio) FROM s2 WHERE level <= ratio) AS final FROM s2),
s4 AS (SELECT source, source_size, least(cap::DOUBLE, final * weight) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s4),
r AS (SELECT d.doc_id, d.size, d.k, s.source_size, s.target, CAST(floor(s.rate) AS BIGINT) AS whole,
             s.target - floor(s.rate) * s.source_size AS rest, s.rate - floor(s.rate) AS p,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS run,
             sum(d.size) OVER (PARTITION BY d.source, d.k) AS same
      FROM d JOIN s5 s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, whole + CASE WHEN p > 0 AND rest > 0 AND run - same < rest AND run - same + same / 2 <= rest
                             THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM c
"""
