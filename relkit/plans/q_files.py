"""Sinks and file readers (S5, S7-S14, W10): the fixtures are written to a
fresh folder of the shared scratch space and read back by the file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.plans import fixtures as fx
from relkit.plans.q_corpus import corpus_stats
from relkit.plans.q_tables import _CLEAN, _records, _web_tables
from relkit.plans.registry import _ORACLE, register
from relkit.session import shared_folder
from relkit.sources import trec
from relkit.sources import webtables as wt


def _judgements(df):
    return df.select(F.col("qid").alias("topic"), F.col("docno").alias("json_loc"), F.col("label").alias("relevancy"))


@register("qrels_file_round_trip", fx.sql_with(["v_qrels_a"], """
    SELECT CAST(qid AS VARCHAR) AS qid, docno, CAST(label AS INTEGER) AS label FROM v_qrels_a"""))
def qrels_file_round_trip(spark, sf):
    """S7 + S5: judgements written as qrels text, read as a tab-separated table."""
    path = shared_folder(spark, "qrels")
    trec.write_qrels(_judgements(fx.spark_qrels_a(spark, sf)), path)
    return trec.read_qrels_tsv(spark, path)


@register("label_files", fx.sql_with(["v_qrels_a", "v_qrels_b"], """
    SELECT 'human' AS variant, CAST(qid AS INTEGER) AS topic, 0 AS iteration, docno AS json_loc,
           CAST(label AS INTEGER) AS relevancy FROM v_qrels_a
    UNION ALL SELECT 'llm', CAST(qid AS INTEGER), 0, docno, CAST(label AS INTEGER) FROM v_qrels_b"""))
def label_files(spark, sf):
    """Label sets of the same file name in two folders, read in one scan."""
    top = shared_folder(spark, "labels")
    paths = {"human": f"{top}/human/qrels", "llm": f"{top}/llm/qrels"}
    trec.write_qrels(_judgements(fx.spark_qrels_a(spark, sf)), paths["human"])
    trec.write_qrels(_judgements(fx.spark_qrels_b(spark, sf)), paths["llm"])
    return trec.read_label_files(spark, paths).drop("relevancy_raw")


@register("judgement_json_lines", fx.sql_with(["v_table_qrels"], """
    SELECT '{"topic":' || topic || ',"iteration":0,"json_loc":"' || json_loc || '","relevancy":' || relevancy || '.0}'
             AS value FROM v_table_qrels"""))
def judgement_json_lines(spark, sf):
    """Judgements as JSON lines."""
    return trec.judgement_json(fx.spark_table_qrels(spark, sf))


@register("corpus_stats_round_trip", _ORACLE["corpus_stats"])
def corpus_stats_round_trip(spark, sf):
    """S9 + S10: corpus statistics written as gzip JSON lines and read back."""
    path = shared_folder(spark, "stats")
    wt.write_corpus_stats(corpus_stats(spark, sf), path)
    return wt.read_corpus_stats(spark, path)


@register("corpus_stats_losses", fx.sql_with(["v_web_raw"], """
    SELECT count(*) AS n_lines, count(*) FILTER (WHERE CAST(substr(json_loc, 2) AS BIGINT) % 10 <> 7) AS n_rows,
           count(*) FILTER (WHERE CAST(substr(json_loc, 2) AS BIGINT) % 10 = 7) AS n_lost, 0 AS n_broken FROM webc""",
    _CLEAN))
def corpus_stats_losses(spark, sf):
    """What a load of gzip JSON lines read and lost, every tenth line being
    cut short; files that break off are a case of the tests."""
    path = shared_folder(spark, "stats")
    stats = corpus_stats(spark, sf).select("json_loc", F.to_json(F.struct("json_loc", "length", "rated")).alias("value"))
    cut = F.substring("json_loc", 2, 20).cast("bigint") % 10 == 7
    stats.select(F.when(cut, F.substring("value", 1, 12)).otherwise(F.col("value")).alias("value")) \
        .write.option("compression", "gzip").text(path)
    _, losses = wt.read_corpus_stats_counted(spark, path)
    return losses.agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_rows", "n_lost")],
                      F.count_if("broken").cast("int").alias("n_broken"))


def _as_text(columns):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])


def _columns(name):
    return [c for c in wt.RELATIONS[name].names if c != "json_loc"]


@register("stored_relations", fx.sql_with(["v_web_raw"], " UNION ALL ".join(
    f"SELECT '{n}' AS relation_name, json_loc, md5(concat_ws('|', "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _columns(n)) + f")) AS content FROM w_{n}"
    for n in wt.RELATIONS), _CLEAN))
def stored_relations(spark, sf):
    """The seven relations written in one pass and read back, each with its
    own schema."""
    path = shared_folder(spark, "relations")
    wt.write_relations(_records(spark, sf), path)
    out = None
    for name in wt.RELATIONS:
        rows = wt.read_relation(spark, path, name).select(F.lit(name).alias("relation_name"), "json_loc",
                                                          F.md5(_as_text(_columns(name))).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("stored_key_faults", fx.sql_with(["v_web_raw"], """
    SELECT relation_name, fault, json_loc, n FROM (
        SELECT c.*, unnest([CASE WHEN json_loc IS NULL THEN 'null_key' END,
                            CASE WHEN json_loc IS NOT NULL AND n > 1 THEN 'duplicate_key' END,
                            CASE WHEN json_loc IS NOT NULL AND json_loc NOT IN (SELECT json_loc FROM k
                                 WHERE relation_name = 'web_table' AND json_loc IS NOT NULL) THEN 'orphan' END]) AS fault
        FROM (SELECT relation_name, json_loc, count(*) AS n FROM k GROUP BY relation_name, json_loc) c)
    WHERE fault IS NOT NULL""", {
        **_CLEAN,
        "kn": "SELECT json_loc, CAST(substr(json_loc, 2) AS BIGINT) AS number FROM webc",
        "k": """SELECT 'web_table' AS relation_name, json_loc FROM kn WHERE number % 13 <> 0
                UNION ALL SELECT 'text_before', json_loc FROM kn
                UNION ALL SELECT 'text_before', json_loc FROM kn WHERE number % 7 = 0
                UNION ALL SELECT 'page_title', CASE WHEN number % 11 <> 0 THEN json_loc END FROM kn
                """ + " ".join(f"UNION ALL SELECT '{n}', json_loc FROM kn"
                               for n in ("table_meta", "text_after", "table_entities", "page_url"))}))
def stored_key_faults(spark, sf):
    """Null, duplicate and orphan keys of the seven relations, of which some
    are made faulty: tables without their row, rows twice, keys lost."""
    t = _web_tables(spark, sf)
    number = F.substring("json_loc", 2, 20).cast("bigint")
    t["web_table"] = t["web_table"].where(number % 13 != 0)
    t["text_before"] = t["text_before"].unionByName(t["text_before"].where(number % 7 == 0))
    t["page_title"] = t["page_title"].withColumn("json_loc", F.when(number % 11 != 0, F.col("json_loc")))
    return wt.key_faults(t)


@register("field_files", fx.sql_with(["v_rater_long"], """
    SELECT CAST(doc_id % 50 AS INTEGER) AS topic, 0 AS iteration, CAST(doc_id AS VARCHAR) AS json_loc,
           CAST(label AS INTEGER) AS relevancy, field FROM v_rater_long WHERE rater = 'human' AND label IS NOT NULL"""))
def field_files(spark, sf):
    """The judgements of five fields, a file each, read back in one scan."""
    long = fx.spark_rater_long(spark, sf).where("rater = 'human' AND label IS NOT NULL")
    top = shared_folder(spark, "fields")
    rows = long.select("field", (F.col("doc_id") % 50).alias("topic"), F.col("doc_id").cast("string").alias("json_loc"),
                       F.col("label").alias("relevancy"))
    paths = {f: f"{top}/{f}" for f in fx.RATER_FIELDS}
    for f, path in paths.items():
        trec.write_qrels(rows.where(F.col("field") == f), path)
    return trec.read_field_files(spark, paths)


@register("ordered_qrels_lines", fx.sql_with(["v_qrels_a"], """
    SELECT row_number() OVER (ORDER BY qid, docno) AS line_no,
           concat_ws(chr(9), CAST(qid AS VARCHAR), '0', docno, CAST(label AS VARCHAR)) AS value FROM v_qrels_a"""))
def ordered_qrels_lines(spark, sf):
    """Qrels lines written in order and read back with their line numbers."""
    path = shared_folder(spark, "ordered")
    q = fx.spark_qrels_a(spark, sf)
    lines = q.select("qid", "docno", F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), "docno",
                                                 F.col("label").cast("string")).alias("value"))
    trec.write_ordered(lines, path, ["qid", "docno"])
    return trec.numbered_lines(spark, path).select("line_no", "value")
