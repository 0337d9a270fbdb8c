"""TREC text formats: qrels (4 fields), runs (6 fields), topics (id + query)
and the qrels writer (S2-S5, S7, S8, S13, S14).

Readers take paths (``spark.read.text``; one scan for many files, the file
name kept from ``_metadata``) or an already loaded DataFrame with a ``value``
column (``parse_*``), so the same parsing runs on files and on derived text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relkit.operators.agreement import parse_label

# whitespace as str.split() sees it
WS = r"(?U)\s+"
WS_ENDS = r"(?U)^\s+|\s+$"


def _stripped(value: str):
    return F.regexp_replace(F.col(value), WS_ENDS, "")


def _fields(value: str = "value"):
    return F.split(_stripped(value), WS)


def _path_part(path):
    """The path of a file URI, without scheme and host, percent signs decoded."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file, _pos); ``_pos`` grows along each file.  ``numbered_lines`` has dense numbers."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths))
    df = df.select("value", F.col("_metadata.file_path").alias("file"),
                   F.monotonically_increasing_id().alias("_pos"))
    return df


def parse_qrels(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep lines with exactly 4 whitespace fields (others are dropped, as
    the reference does): (topic, iteration, json_loc, relevancy, relevancy_raw).
    Labels may be float text ('1.0'); unparsable labels give null."""
    parts = lines.withColumn("_f", _fields(value)).where(F.size("_f") == 4)
    keep = [c for c in lines.columns if c != value]
    return parts.select(
        *keep,
        F.col("_f")[0].try_cast("int").alias("topic"),
        F.col("_f")[1].try_cast("int").alias("iteration"),
        F.col("_f")[2].alias("json_loc"),
        parse_label(F.col("_f")[3]).alias("relevancy"),
        F.col("_f")[3].alias("relevancy_raw"))


def parse_run(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep lines with exactly 6 fields: (qid, q0, docno, rank, score, tag)."""
    parts = lines.withColumn("_f", _fields(value)).where(F.size("_f") == 6)
    return parts.select(
        F.col("_f")[0].alias("qid"), F.col("_f")[1].alias("q0"), F.col("_f")[2].alias("docno"),
        F.col("_f")[3].try_cast("int").alias("rank"), F.col("_f")[4].try_cast("double").alias("score"),
        F.col("_f")[5].alias("tag"))


def parse_topics(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """Split on the first whitespace run into (qid, query).  Any other line
    (incl. blank) is an error in the reference: here those rows are returned
    by ``bad_topic_lines`` and excluded.  A repeated id keeps the LAST query
    (by ``order``, the line position)."""
    parts = lines.withColumn("_f", F.split(_stripped(value), WS, 2))
    good = parts.where(F.size("_f") == 2)
    good = good.select(F.col("_f")[0].alias("qid"), F.col("_f")[1].alias("query"),
                       *([F.col(order)] if order else []))
    if order:
        # last wins: max_by over the position, one aggregation
        return good.groupBy("qid").agg(F.max_by("query", order).alias("query"))
    return good.dropDuplicates(["qid"])


def bad_topic_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    parts = lines.withColumn("_f", F.split(_stripped(value), WS, 2))
    return parts.where(F.size("_f") != 2).drop("_f")


def read_qrels(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_qrels(read_lines(spark, paths))


def read_run(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_run(read_lines(spark, paths))


def read_topics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_topics(read_lines(spark, paths), order="_pos")


def read_qrels_tsv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tab-delimited qrels with named columns, iteration dropped."""
    schema = "qid STRING, iteration STRING, docno STRING, label STRING"
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", schema=schema)
    return df.drop("iteration").withColumn("label", parse_label("label"))


def _named_lines(spark: SparkSession, paths: dict[str, str], column: str) -> DataFrame:
    """The lines of many files in one scan, each with the name of the path it was
    read through: a file, a folder or a glob; of several, the longest.  A file of
    none is an error."""
    lines = spark.read.text(list(paths.values())).select("value", F.col("_metadata.file_path").alias("file"))
    # _metadata.file_path is a URI: compare whole paths, of the file or its folder
    file = _path_part(F.col("file"))

    def under(path: str):
        local = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", path) if ":/" in path else os.path.abspath(path)
        local = local.rstrip("/")
        if not re.search(r"[*?]", local):
            return (file == local) | file.startswith(local + "/")
        glob = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in local)
        return file.rlike(f"^{glob}(/|$)")

    longest = sorted(paths.items(), key=lambda kv: (-len(kv[1]), kv[0]))
    unknown = F.raise_error(F.concat(F.lit("read through none of the paths: "), file)).cast("string")
    return lines.select("value", F.coalesce(*[F.when(under(p), F.lit(k)) for k, p in longest], unknown).alias(column))


def read_label_files(spark: SparkSession, variants: dict[str, str]) -> DataFrame:
    """Many label files in ONE scan; each file's path is mapped to its
    variant name.  (variant, topic, iteration, json_loc, relevancy)."""
    return parse_qrels(_named_lines(spark, variants, "variant"))


def read_field_files(spark: SparkSession, fields: dict[str, str]) -> DataFrame:
    """The judgement files of several fields, united in one scan:
    (topic, iteration, json_loc, relevancy, field)."""
    out = parse_qrels(_named_lines(spark, fields, "field"))
    return out.select("topic", "iteration", "json_loc", "relevancy", "field")


def qrels_lines(judgements: DataFrame, iteration: int = 0) -> DataFrame:
    """One ``topic<TAB>iteration<TAB>json_loc<TAB>relevancy`` line per row."""
    return judgements.select(F.concat_ws(
        "\t", F.col("topic").cast("string"), F.lit(str(iteration)), F.col("json_loc"),
        F.col("relevancy").cast("string")).alias("value"))


def write_qrels(judgements: DataFrame, path: str, mode: str = "overwrite", iteration: int = 0) -> None:
    """Write the judgements as TREC qrels text (default overwrite, not the
    reference's append-on-rerun)."""
    qrels_lines(judgements, iteration).write.mode(mode).text(path)


def judgement_json(judgements: DataFrame, iteration: int = 0) -> DataFrame:
    """JSON form with the relevancy as a float."""
    return judgements.select(F.to_json(F.struct(
        F.col("topic"), F.lit(iteration).alias("iteration"), F.col("json_loc"),
        F.col("relevancy").cast("double").alias("relevancy"))).alias("value"))


def write_ordered(rows: DataFrame, path: str, order: Sequence[str], value: str = "value",
                  mode: str = "overwrite") -> None:
    """Text lines in the order of ``order``: ranges of it go to files whose
    names sort likewise, so the lines of the folder are in order as a whole."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.mode(mode).text(path)


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], per_file: bool = False) -> DataFrame:
    """(file, line_no, value): dense line numbers from 1 over the files in the order
    of their names, or within each file.

    Two passes: the first counts the lines of every split and sums them up in
    order (one row a split); the second adds a line's place in its split to the
    lines before it.  A split is read by one task from front to back, so that place
    follows from the running number of the task's rows; lines are not sorted."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"))
    splits = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = splits.select("file", "block", "first", before.alias("before"))
    return df.join(begin, ["file", "block"]).select(
        "file", (F.col("before") + F.col("pos") - F.col("first") + 1).alias("line_no"), "value")
