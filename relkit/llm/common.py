"""Helpers shared by the corpus operators: reading the needed columns of any
documents-like table, shared scratch tables, label splits, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relkit.session import ensure_checkpoint_dir

#: Rows of one Arrow batch sent to Python.  Together with Spark's own byte
#: bound per batch this keeps a worker's memory independent of the table.
ARROW_ROWS = 500
ARROW_BYTES = "16m"


def pick(docs: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; a missing column is
    null.  Columns are found by position, so other columns of any name (also
    names that differ in case only, or names an operator uses itself) are
    simply left behind."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for name, kind in types.items():
        at = names.index(name) if name in names else \
            next((i for i, n in enumerate(names) if n.lower() == name.lower()), None)
        out.append((F.lit(None) if at is None else F.col(f"c{at}")).cast(kind).alias(name))
    return flat.select(*out)


def with_row(docs: DataFrame, **types: str) -> DataFrame:
    """``pick`` plus the whole row in a struct ``row``; ``rows_of`` restores it."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = [F.struct(*[F.col(f"c{i}") for i in range(len(names))]).alias("row")]
    for name, kind in types.items():
        at = names.index(name) if name in names else \
            next((i for i, n in enumerate(names) if n.lower() == name.lower()), None)
        out.append((F.lit(None) if at is None else F.col(f"c{at}")).cast(kind).alias(name))
    return flat.select(*out)


def rows_of(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(names))]).toDF(*names)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/relkit-{label}-{uuid.uuid4().hex}"


def lean(spark: SparkSession) -> None:
    """Shuffle files go when the query that made them ends; what later queries
    need is in a table or checkpoint by then."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder and read it back; a lost
    executor loses nothing, and later readers prune its columns."""
    lean(df.sparkSession)
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``written`` in buckets of ``key``, as many as there are shuffle partitions: joins on
    ``key`` deal out the other side only.  A table of the session's catalog, its files in the
    shared folder; ``df`` is to be dealt by ``dealt`` before."""
    spark = df.sparkSession
    lean(spark)
    name = f"relkit_{label}_{uuid.uuid4().hex}".replace("-", "_")
    (df.write.bucketBy(shuffle_partitions(spark), key).option("compression", "zstd")
     .option("path", scratch(spark, label)).saveAsTable(name))
    return spark.table(name)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in the partitions of the buckets of ``key``."""
    return df.repartition(shuffle_partitions(df.sparkSession), key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return remainder(doc_id, mod) == rest


def ready(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on every executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_relkit_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # kept for the life of the driver: executors that start later fetch it too
    path = os.path.join(tempfile.mkdtemp(prefix="relkit-ship-"), "relkit.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._relkit_shipped = True


#: Values of a label that a sample tells apart.
MOST_CLASSES = 1000


def smallest(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """(label, h, doc_id) of the ``per_class`` smallest hashes of ids in each class.
    Only narrow rows move; the window group limit leaves ``per_class`` of a class
    on each task before the shuffle, however many rows the class has."""
    h = F.xxhash64("doc_id").alias("h")
    n = F.dense_rank().over(Window.partitionBy(label).orderBy("h"))
    return rows.select(label, h, "doc_id").withColumn("n", n).where(F.col("n") <= per_class).drop("n")


def stratified_sample(rows: DataFrame, label: str, per_class: int, *keep: str) -> DataFrame:
    """(label, *keep) of at most ``per_class`` ids of every value of ``label`` (of
    the first MOST_CLASSES values), one row an id."""
    cuts = (smallest(rows, label, per_class).groupBy(label).agg(F.max("h").alias("cut"))
            .orderBy(label).limit(MOST_CLASSES).collect())
    cut = F.lit(None).cast("bigint")
    for r in cuts:
        cut = F.when(F.col(label) == r[0], F.lit(r[1])).otherwise(cut)
    rows = rows.withColumn("h", F.xxhash64("doc_id")).where(F.col("h") <= cut)
    return rows.groupBy(label, "h").agg(F.min(F.struct(*keep)).alias("s")).select(label, "s.*")


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int,
             per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) for at most ``per_class`` ids of each class, learned only
    from ids outside the held-out part, and the rows of each class before the
    cut.  An id with several labels counts as the larger, one with several texts
    gives the smallest text.  The ids that are broadcast are bounded by
    2 * ``per_class``."""
    lab = pick(labels, doc_id="bigint", **{label: "int"})
    lab = lab.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), mod, rest))
    lab = lab.groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    ids = F.broadcast(smallest(lab, "y", per_class).select("doc_id", "y"))
    rows = pick(docs, doc_id="bigint", text="string").join(ids, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), counts


class Covered:
    """Spans of a text; ``free`` tells whether another overlaps none of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)  # spans before i begin before the end
        return i == 0 or self.ends[i - 1] <= start
