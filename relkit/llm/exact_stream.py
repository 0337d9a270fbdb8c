"""Exact dedup by a stateful stream.

Rows arrive as a stream of (digest, identifier, locator).  A streaming
aggregation keeps one record per digest in RocksDB (on the executors' disks,
checkpointed to the shared folder) without watermark, so it never expires: the
digest, the stable identifier of the row that stays, its content locator and
the number of rows seen.  Partial aggregation runs before the shuffle, so a
text with a third of all rows reaches its state as one record per task.

The digest alone decides nothing: rows that share one are compared by their
whole normalised bytes (grouping by digest and content, again collapsed before
the shuffle).  A digest with two contents is split by content.

Rules: null text counts as empty; texts are equal when identical without
``[\\x20\\x09-\\x0D]``; the row with most code points in the original text stays,
then the smallest doc_id (null last), then the first row read.  Repeated rows
(same id and text) are members like any other; exactly one row of a group is
kept.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import lean, pick, scratch, with_row, rows_of

NOT_TEXT = r"[\x20\x09-\x0D]+"

#: State lives on disk; only changes are uploaded at a commit.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: space set aside for each one's logs would exceed the data
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_of(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_TEXT, "")


def arrivals(docs: DataFrame, digest: Callable[[Column], Column], rows: bool) -> DataFrame:
    """(rid, doc_id, n_chars, digest) and ``row``, the whole input row with its
    text, or ``content``, the normalised text alone.  ``rid`` is the locator of
    the content in the table this is written to."""
    d = with_row(docs, doc_id="bigint", text="string")
    content = content_of(F.col("text"))
    n_chars = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("n_chars")
    d = d.select("doc_id", n_chars, content.alias("content"), *[F.struct("row", "text").alias("row")] * rows)
    d = d.withColumn("digest", digest(F.col("content"))).withColumn("rid", F.monotonically_increasing_id())
    return d.select("rid", "doc_id", "n_chars", "digest", "row.row" if rows else "content")


def best_of() -> Column:
    """Largest = stays: most code points, smallest id, first read; ``~x``
    reverses an order without overflow and keeps null last."""
    return F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("at")))


def stream_state(arriving: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream over what has arrived, then read the state it left:
    (digest, best, n).  Starting again with the same ``checkpoint`` reads only
    new files and goes on from the stored state."""
    spark = arriving.sparkSession
    seen = arriving.groupBy("digest").agg(best_of().alias("best"), F.count(F.lit(1)).alias("n"))
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        q = (seen.writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    best, n = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key.digest").alias("digest"),
                        F.col("value")[best].alias("best"), F.col("value")[n].alias("n"))


def classed(docs: DataFrame, digest: Callable[[Column], Column], rows: bool) -> DataFrame:
    """Every row with its group: doc_id, digest, keep_id, n, kept, and row or content."""
    spark = docs.sparkSession
    arriving = arrivals(docs, digest, rows)
    lean(spark)
    store = scratch(spark, "dedup-arrivals")
    arriving.write.option("compression", "zstd").parquet(store)
    narrow = "rid bigint, doc_id bigint, n_chars bigint, digest string"
    state = stream_state(spark.readStream.schema(narrow).parquet(store), scratch(spark, "dedup-state"))
    table = spark.read.schema(arriving.schema).parquet(store)
    if rows:
        names = docs.columns
        at = next(i for i, n in enumerate(names) if n.lower() == "text") if "text" not in names else names.index("text")
        table = table.withColumn("content", content_of(F.col(f"row.c{at}").cast("string")))
    out = [F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.at").alias("keep_rid"), "n"]
    # full bytes: the digests that stand for several contents (none, if it is sound)
    contents = table.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("rows"))
    several = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    several = several.select("digest").checkpoint()
    last = ["doc_id", "digest", "keep_id", "n", (F.col("rid") == F.col("keep_rid")).alias("kept"),
            "row" if rows else "content"]
    if several.isEmpty():  # contents need not be told apart, and so not move again
        return table.join(state.select("digest", *out), "digest").select(*last)
    one = state.join(several, "digest", "left_anti").select("digest", *out)
    part = table.join(several, "digest", "left_semi")
    many = (part.groupBy("digest", "content").agg(best_of().alias("best"), F.count(F.lit(1)).alias("n"))
            .select("digest", "content", *out))
    return (table.join(one, "digest").select(*last)
            .unionByName(part.join(many, ["digest", "content"]).select(*last)))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    out = classed(pick(docs, doc_id="bigint", text="string"), digest, rows=False)
    name = F.col("digest") if digest is sha256 else sha256(F.col("content"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", name.alias("text_sha256"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return rows_of(classed(docs, digest, rows=True).where("kept"), docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER g = 1 AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
