"""Web-table JSON Lines source and the normalised seven-relation sink
(S1, S9-S12, P1, F16).

The schema is fixed (never inferred).  Undecodable lines (incl. blank ones)
go to a quarantine frame instead of stopping the load; records with missing
keys are kept with nulls and flagged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relkit.functions.relation import clean_relation, strip_nul, strip_nul_cells

WEB_TABLE_SCHEMA = T.StructType([
    T.StructField("json_loc", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("relation", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("tableType", T.StringType()),
    T.StructField("hasKeyColumn", T.BooleanType()),
    T.StructField("keyColumnIndex", T.IntegerType()),
    T.StructField("hasHeader", T.BooleanType()),
    T.StructField("headerPosition", T.StringType()),
    T.StructField("headerRowIndex", T.IntegerType()),
    T.StructField("tableOrientation", T.StringType()),
    T.StructField("tableNum", T.IntegerType()),
    T.StructField("recordEndOffset", T.LongType()),  # of a place in a dump that may exceed 2 GB
    T.StructField("recordOffset", T.LongType()),
    T.StructField("textBeforeTable", T.StringType()),
    T.StructField("textAfterTable", T.StringType()),
    T.StructField("entities", T.StringType()),   # opaque JSON kept as text
    T.StructField("pageTitle", T.StringType()),
    T.StructField("url", T.StringType()),
])
REQUIRED_KEYS = [f.name for f in WEB_TABLE_SCHEMA.fields]

CORPUS_STATS_SCHEMA = "json_loc STRING, length INT, rated BOOLEAN"


def read_jsonl_lines(spark: SparkSession, paths: str | Sequence[str], skip_first_line: bool = False) -> DataFrame:
    """Raw lines (``value``).  ``skip_first_line`` drops line 1 of EVERY file
    (the reference's reader does): a single-column CSV read with the header
    option and a separator/quote that never split a JSON line."""
    p = paths if isinstance(paths, str) else list(paths)
    if skip_first_line:
        return (spark.read.option("header", True).option("sep", "\u0001").option("quote", "")
                .option("escape", "").option("maxCharsPerColumn", "-1")
                .schema("value STRING").csv(p))
    return spark.read.text(p)


def parse_web_tables(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine).  Records: the fixed schema + ``missing_keys``
    (array of absent/null keys).  Quarantine: lines that are not JSON objects."""
    v = F.col(value)
    ok = F.try_parse_json(v).isNotNull() & F.trim(v).startswith("{")
    parsed = lines.where(ok).select(F.from_json(v, WEB_TABLE_SCHEMA).alias("r"), v.alias("_raw"))
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.json_object_keys("_raw"))
    records = parsed.select("r.*", missing.alias("missing_keys"))
    quarantine = lines.where(~ok | v.isNull()).select(v.alias("line"))
    return records, quarantine


def read_web_tables(spark: SparkSession, paths: str | Sequence[str],
                    skip_first_line: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_web_tables(read_jsonl_lines(spark, paths, skip_first_line))


def judged_only(records: DataFrame, judged_keys: DataFrame, key: str = "json_loc") -> DataFrame:
    """Keep records whose key is judged -- applied BEFORE cleaning, so
    unjudged tables are never cleaned.  AQE plans the join from
    the size of the key set."""
    return records.join(judged_keys.select(key).distinct(), key, "left_semi")


def clean_records(records: DataFrame) -> DataFrame:
    """Cell cleaning (F1, F2) and NUL stripping (F16) of every string field."""
    df = clean_relation(records, "relation", "relation")
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(strip_nul(f.name).alias(f.name))
        elif f.name == "relation":
            cols.append(strip_nul_cells("relation").alias("relation"))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def normalise(records: DataFrame) -> dict[str, DataFrame]:
    """The seven relations keyed by json_loc (schema of the reference
    DDL).  The relation is stored as JSON text."""
    r = records
    return {
        "web_table": r.select("json_loc", "title", F.to_json("relation").alias("relation"),
                              F.col("tableType").alias("table_type")),
        "table_meta": r.select(
            "json_loc", F.col("hasKeyColumn").alias("has_key_column"),
            F.col("keyColumnIndex").alias("key_column_index"), F.col("hasHeader").alias("has_header"),
            F.col("headerPosition").alias("header_pos"), F.col("headerRowIndex").alias("header_row_index"),
            F.col("tableOrientation").alias("table_orientation"), F.col("tableNum").alias("table_num"),
            F.col("recordEndOffset").alias("record_end_offset"), F.col("recordOffset").alias("record_offset")),
        "text_before": r.select("json_loc", F.col("textBeforeTable").alias("text_before")),
        "text_after": r.select("json_loc", F.col("textAfterTable").alias("text_after")),
        "table_entities": r.select("json_loc", F.col("entities")),
        "page_title": r.select("json_loc", F.col("pageTitle").alias("page_title")),
        "page_url": r.select("json_loc", F.col("url")),
    }


#: Schemas of the stored relations, all keyed by json_loc.
RELATIONS: dict[str, T.StructType] = {name: T.StructType([
    T.StructField("json_loc", T.StringType(), False), *[T.StructField(c, t) for c, t in columns]]) for name, columns in {
        "web_table": [("title", T.StringType()), ("relation", T.StringType()), ("table_type", T.StringType())],
        "table_meta": [("has_key_column", T.BooleanType()), ("key_column_index", T.IntegerType()),
                       ("has_header", T.BooleanType()), ("header_pos", T.StringType()),
                       ("header_row_index", T.IntegerType()), ("table_orientation", T.StringType()),
                       ("table_num", T.IntegerType()), ("record_end_offset", T.LongType()),
                       ("record_offset", T.LongType())],
        "text_before": [("text_before", T.StringType())],
        "text_after": [("text_after", T.StringType())],
        "table_entities": [("entities", T.StringType())],
        "page_title": [("page_title", T.StringType())],
        "page_url": [("url", T.StringType())],
    }.items()}
PARENT = "web_table"


def relation_rows(records: DataFrame) -> DataFrame:
    """Seven rows a record, one a stored relation: relation_name, json_loc and the
    columns of all relations, null where a column is another relation's."""
    columns = {c.name: c.dataType for r in RELATIONS.values() for c in r.fields if c.name != "json_loc"}
    of = {"relation": F.to_json("relation"), "table_type": F.col("tableType"), "title": F.col("title"),
          "has_key_column": F.col("hasKeyColumn"), "key_column_index": F.col("keyColumnIndex"),
          "has_header": F.col("hasHeader"), "header_pos": F.col("headerPosition"),
          "header_row_index": F.col("headerRowIndex"), "table_orientation": F.col("tableOrientation"),
          "table_num": F.col("tableNum"), "record_end_offset": F.col("recordEndOffset"),
          "record_offset": F.col("recordOffset"), "text_before": F.col("textBeforeTable"),
          "text_after": F.col("textAfterTable"), "entities": F.col("entities"), "page_title": F.col("pageTitle"),
          "url": F.col("url")}
    rows = [F.struct(F.lit(name).alias("relation_name"), *[
        (of[c] if c in schema.names else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        for name, schema in RELATIONS.items()]
    return records.select("json_loc", F.inline(F.array(*rows)))


def write_relations(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All seven relations in one pass over the records, one record a key: one
    parse, one shuffle by key, one write with a folder a relation."""
    relation_rows(records.dropDuplicates(["json_loc"])).write.mode(mode).partitionBy("relation_name").parquet(path)


def read_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One stored relation with its own columns and types."""
    return spark.read.schema(RELATIONS[name]).parquet(f"{path.rstrip('/')}/relation_name={name}")


def key_faults(relations: dict[str, DataFrame], parent: str = PARENT, key: str = "json_loc") -> DataFrame:
    """(relation_name, fault, json_loc, n) of the keys that break the rules of
    the stored relations: ``null_key`` and ``duplicate_key`` (n rows), ``orphan``
    (not in ``parent``).  All relations are counted in one shuffle of their keys;
    the names of a key's relations are gathered, as many as there are relations."""
    keys = None
    for name, df in relations.items():
        k = df.select(F.lit(name).alias("relation_name"), F.col(key).alias("json_loc"))
        keys = k if keys is None else keys.unionByName(k)
    counted = keys.groupBy("json_loc", "relation_name").agg(F.count(F.lit(1)).alias("n"))
    of = counted.groupBy("json_loc").agg(F.collect_list(F.struct("relation_name", "n")).alias("r"))
    has_parent = F.exists("r", lambda x: x["relation_name"] == parent)
    rows = of.select("json_loc", has_parent.alias("has_parent"), F.inline("r"))
    null = F.col("json_loc").isNull()
    faults = F.array(F.when(null, "null_key"), F.when(~null & (F.col("n") > 1), "duplicate_key"),
                     F.when(~null & ~F.col("has_parent"), "orphan"))
    return rows.select("relation_name", F.explode(F.array_compact(faults)).alias("fault"), "json_loc", "n")


def write_corpus_stats(stats: DataFrame, path: str) -> None:
    """Gzip JSON Lines of (json_loc, length, rated)."""
    stats.select("json_loc", "length", "rated").write.mode("overwrite") \
        .option("compression", "gzip").json(path)


def read_corpus_stats(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant reader -- malformed lines and broken files are skipped."""
    return (spark.read.schema(CORPUS_STATS_SCHEMA).option("mode", "DROPMALFORMED")
            .option("ignoreCorruptFiles", "true").json(path))


def gzip_lines(files: DataFrame) -> DataFrame:
    """(file, line, ended, broken) of gzip files given as (path, content), the
    columns of Spark's ``binaryFile`` source: all lines that can be read, also of
    a file that breaks off.  ``ended`` is false for a last line without its line
    end; one more row a file, with a null line, tells whether it is ``broken``.

    A gzip file cannot be split, so a file is one row; it is unpacked in pieces, and
    what is held besides it is one piece and the line that runs over its end."""
    def run(batches):
        import zlib

        import pyarrow as pa
        piece = 1 << 20

        def batch(path, lines, ended=True, broken=None):
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(lines, pa.string()), pa.array([ended] * n),
                 pa.array([broken] * n, pa.bool_())], ["file", "line", "ended", "broken"])

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw, at, rest, data, broken = content.as_buffer(), 0, b"", b"", False
                unpack, more = zlib.decompressobj(31), True
                while more and not broken:
                    try:
                        if not data and at < len(raw):
                            data = raw[at:at + piece].to_pybytes()
                            at += len(data)
                        if data:
                            if unpack.eof:  # a further member of the file
                                unpack = zlib.decompressobj(31)
                            out = unpack.decompress(data, 8 * piece)
                            data = (unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
                        else:
                            out, more = unpack.flush(), False
                        *lines, rest = (rest + out).split(b"\n")
                        if lines:
                            yield batch(path, [x.decode("utf-8", "replace") for x in lines])
                    except zlib.error:
                        broken = True
                broken = broken or (len(raw) > 0 and not unpack.eof)
                if rest:
                    yield batch(path, [rest.decode("utf-8", "replace")], not broken)
                yield batch(path, [None], True, broken)

    return files.select("path", "content").mapInArrow(run, "file string, line string, ended boolean, broken boolean")


def read_corpus_stats_counted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S10 with an account: (rows, losses).  Rows keep the readable part of a broken
    file; losses have one row a file: lines, rows, lines lost (not a record, or cut
    off) and whether the file is broken.  Spark's source leaves out empty files."""
    lines = gzip_lines(spark.read.format("binaryFile").load(path))
    record = F.from_json("line", CORPUS_STATS_SCHEMA)
    fine = F.col("line").isNotNull() & F.col("ended") & F.coalesce(record["json_loc"].isNotNull(), F.lit(False))
    parsed = lines.select("*", record.alias("r"), fine.alias("fine"))
    read = F.count("line")
    losses = parsed.groupBy("file").agg(
        read.alias("n_lines"), F.count_if("fine").alias("n_rows"), (read - F.count_if("fine")).alias("n_lost"),
        F.max("broken").alias("broken"))
    return parsed.where("fine").select("r.*"), losses
