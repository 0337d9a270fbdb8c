"""TREC text parsing queries (S2-S4): lines derived from the fixtures,
including broken ones, parsed with the same functions the file readers use."""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.plans import fixtures as fx
from relkit.plans.registry import register
from relkit.sources import trec

_SPLIT = r"regexp_split_to_array(trim(regexp_replace(value, '\s+', ' ', 'g')), ' ')"


def _qrels_text(spark, sf):
    a = fx.spark_qrels_a(spark, sf)
    lab = F.when(F.col("docno").endswith("7"), F.concat(F.col("label").cast("string"), F.lit(".0"))) \
        .otherwise(F.col("label").cast("string"))
    good = a.select(F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), "docno", lab).alias("value"))
    two = a.where(F.col("label") == 2)
    three = two.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), "docno").alias("value"))
    five = two.select(F.concat_ws("  ", F.col("qid").cast("string"), F.lit("0"), "docno",
                                  F.col("label").cast("string"), F.lit("x")).alias("value"))
    none = a.where((F.col("label") == 1) & F.col("docno").endswith("3")).select(
        F.concat(F.col("qid").cast("string"), F.lit(" \t0 "), F.col("docno"), F.lit("\tNone")).alias("value"))
    return good.unionByName(three).unionByName(five).unionByName(none)


_QRELS_LINES = """
    SELECT concat_ws(chr(9), CAST(qid AS VARCHAR), '0', docno,
                     CASE WHEN docno LIKE '%7' THEN CAST(label AS VARCHAR) || '.0' ELSE CAST(label AS VARCHAR) END)
             AS value FROM v_qrels_a
    UNION ALL SELECT concat_ws(' ', CAST(qid AS VARCHAR), '0', docno) FROM v_qrels_a WHERE label = 2
    UNION ALL SELECT concat_ws('  ', CAST(qid AS VARCHAR), '0', docno, CAST(label AS VARCHAR), 'x')
              FROM v_qrels_a WHERE label = 2
    UNION ALL SELECT CAST(qid AS VARCHAR) || ' ' || chr(9) || '0 ' || docno || chr(9) || 'None'
              FROM v_qrels_a WHERE label = 1 AND docno LIKE '%3'"""


@register("parse_qrels_lines", fx.sql_with(["v_qrels_a"], f"""
    SELECT TRY_CAST(f[1] AS INTEGER) AS topic, TRY_CAST(f[2] AS INTEGER) AS iteration, f[3] AS json_loc,
           TRY_CAST(trunc(TRY_CAST(f[4] AS DOUBLE)) AS INTEGER) AS relevancy, f[4] AS relevancy_raw
    FROM (SELECT {_SPLIT} AS f FROM lines) WHERE len(f) = 4""", {"lines": _QRELS_LINES}))
def parse_qrels_lines(spark, sf):
    """4-field lines kept (3- and 5-field lines dropped), float and
    'None' labels handled."""
    return trec.parse_qrels(_qrels_text(spark, sf))


@register("parse_topics_lines", fx.sql_with(["v_topics"], """
    SELECT f[1] AS qid, max_by(f[2], pos) AS query FROM (
        SELECT regexp_split_to_array(trim(value), '\\s+') AS f0, pos,
               [regexp_extract(trim(value), '^(\\S+)\\s+(.*)$', 1), regexp_extract(trim(value), '^(\\S+)\\s+(.*)$', 2)]
                 AS f
        FROM lines WHERE regexp_matches(trim(value), '^\\S+\\s+\\S'))
    GROUP BY f[1]""", {"lines": """
        SELECT CAST(qid AS VARCHAR) || ' ' || query AS value, qid * 3 AS pos FROM v_topics
        UNION ALL SELECT CAST(qid AS VARCHAR) || '  dup ' || query, qid * 3 + 1 FROM v_topics WHERE qid % 7 = 0
        UNION ALL SELECT CAST(qid AS VARCHAR), qid * 3 + 2 FROM v_topics WHERE qid % 11 = 0"""}))
def parse_topics_lines(spark, sf):
    """Id + query split on the first whitespace run; a repeated id keeps
    its last query; one-field lines are rejected (see ``bad_topic_lines``)."""
    t = fx.spark_topics(spark, sf)
    lines = (t.select(F.concat_ws(" ", F.col("qid").cast("string"), "query").alias("value"),
                      (F.col("qid") * 3).alias("pos"))
             .unionByName(t.where(F.col("qid") % 7 == 0).select(
                 F.concat(F.col("qid").cast("string"), F.lit("  dup "), F.col("query")).alias("value"),
                 (F.col("qid") * 3 + 1).alias("pos")))
             .unionByName(t.where(F.col("qid") % 11 == 0).select(
                 F.col("qid").cast("string").alias("value"), (F.col("qid") * 3 + 2).alias("pos"))))
    return trec.parse_topics(lines, order="pos")


@register("parse_run_lines", fx.sql_with(["v_qrels_b"], f"""
    SELECT f[1] AS qid, f[2] AS q0, f[3] AS docno, TRY_CAST(f[4] AS INTEGER) AS rank,
           TRY_CAST(f[5] AS DOUBLE) AS score, f[6] AS tag
    FROM (SELECT {_SPLIT} AS f FROM lines) WHERE len(f) = 6""", {"lines": """
        SELECT concat_ws(' ', CAST(qid AS VARCHAR), 'Q0', docno, CAST(label + 1 AS VARCHAR),
                         CAST(label * 1.5 AS VARCHAR), 'run') AS value FROM v_qrels_b
        UNION ALL SELECT concat_ws(' ', CAST(qid AS VARCHAR), 'Q0', docno, 'run') FROM v_qrels_b WHERE label = 1"""}))
def parse_run_lines(spark, sf):
    """S3: 6-field run lines kept, others dropped."""
    b = fx.spark_qrels_b(spark, sf)
    good = b.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), "docno",
                                (F.col("label") + 1).cast("string"), (F.col("label") * 1.5).cast("string"),
                                F.lit("run")).alias("value"))
    bad = b.where(F.col("label") == 1).select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), "docno",
                                                          F.lit("run")).alias("value"))
    return trec.parse_run(good.unionByName(bad))
