"""Corpus statistics and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.functions import prompt as pr
from relkit.operators import corpus as co
from relkit.plans import fixtures as fx
from relkit.plans.q_judge import _PROMPT_CTES, _PV, _TJ, _rated
from relkit.plans.registry import register
from relkit.session import table

_PIECE = pr.TOKEN_PIECE.replace("'", "''")
_LEN = f"""SELECT d.doc_id, CAST(len(regexp_extract_all(d.text, '{_PIECE}')) AS BIGINT) AS n_tokens,
                  d.doc_id IN (SELECT doc_id FROM labels) AS rated FROM documents d"""


def _lengths(spark, sf):
    docs = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id").distinct().withColumn("_r", F.lit(True))
    return (docs.select("doc_id", pr.token_count("text").alias("n_tokens"))
            .join(lab, "doc_id", "left")
            .select("doc_id", "n_tokens", F.coalesce(F.col("_r"), F.lit(False)).alias("rated")))


@register("token_lengths", _LEN)
def token_lengths(spark, sf):
    """tokens per document, with the judged flag."""
    return _lengths(spark, sf)


@register("corpus_stats", fx.sql_with(_PV, f"""
    SELECT w.json_loc, CAST(len(regexp_extract_all({_TJ}, '{_PIECE}')) AS INTEGER) AS length,
           w.json_loc IN (SELECT json_loc FROM v_table_qrels) AS rated
    FROM webc w""", _PROMPT_CTES))
def corpus_stats(spark, sf):
    """S9 rows: (json_loc, length in tokens of the table JSON, rated)."""
    from relkit.operators.joins import rated_flag
    from relkit.plans.q_tables import _records
    r = _records(spark, sf).select("json_loc", pr.token_count(pr.table_json("relation")).cast("int")
                                   .alias("length"))
    return rated_flag(r, fx.spark_table_qrels(spark, sf), "json_loc")


@register("log_histogram", f"""
    WITH l AS (SELECT log10(n_tokens) AS v FROM ({_LEN}) WHERE n_tokens > 0),
         b AS (SELECT min(v) AS lo, max(v) AS hi FROM l),
         c AS (SELECT CAST(coalesce(least(floor((v - lo) / ((hi - lo) / 20)), 19), 0) AS INTEGER) AS bin,
                      count(*) AS n FROM l, b GROUP BY 1)
    SELECT CAST(g.range AS INTEGER) AS bin, round(pow(10, lo + g.range * (hi - lo) / 20), 6) AS lo,
           round(pow(10, lo + (g.range + 1) * (hi - lo) / 20), 6) AS hi, coalesce(c.n, 0) AS n
    FROM range(0, 20) g CROSS JOIN b LEFT JOIN c ON c.bin = g.range""")
def log_histogram(spark, sf):
    """20 equal-width bins on a log10 scale of token counts."""
    return co.log_histogram(_lengths(spark, sf))


@register("cost_mean", f"""
    SELECT round(avg(n_tokens), 6) AS mean_tokens,
           round(avg(n_tokens) * {co.PRICE_PER_1K_TOKENS} / 1000 * {co.JUDGED_PAIRS}, 6) AS cost
    FROM ({_LEN})""")
def cost_mean(spark, sf):
    """Mean prompt tokens × price × judged pairs."""
    return co.cost_mean(_lengths(spark, sf))


@register("cost_kth", f"""
    WITH s AS (SELECT n_tokens, row_number() OVER (ORDER BY n_tokens) - 1 AS i FROM ({_LEN})),
         n AS (SELECT count(*) AS n FROM s)
    SELECT (SELECT n_tokens FROM s, n WHERE i = round_even(n / 2.0, 0) + 1) AS kth_tokens,
           (SELECT n_tokens FROM s, n WHERE i = n // 2) AS median_tokens,
           round((SELECT n_tokens FROM s, n WHERE i = round_even(n / 2.0, 0) + 1)
                 * {co.PRICE_PER_1K_TOKENS} / 1000 * {co.JUDGED_PAIRS}, 6) AS cost""")
def cost_kth(spark, sf):
    """The reference's k-th element cost and the true median."""
    return co.cost_kth(_lengths(spark, sf))


@register("max_query_len", fx.sql_with(["v_topics"], f"""
    SELECT max(CAST(len(regexp_extract_all(query, '{_PIECE}')) AS BIGINT)) AS max_query_tokens,
           CAST(len(regexp_extract_all({"'" + pr.USER_PATTERN.replace("$TOPIC", "").replace("$TABLE", "")
                                        .replace("'", "''") + "'"}, '{_PIECE}')) AS BIGINT) AS overhead_tokens,
           max(CAST(len(regexp_extract_all(query, '{_PIECE}')) AS BIGINT))
             + CAST(len(regexp_extract_all({"'" + pr.USER_PATTERN.replace("$TOPIC", "").replace("$TABLE", "")
                                          .replace("'", "''") + "'"}, '{_PIECE}')) AS BIGINT) AS total_tokens
    FROM v_topics"""))
def max_query_len(spark, sf):
    """Longest topic in tokens plus the fixed prompt overhead."""
    overhead = pr.token_count(F.lit(pr.USER_PATTERN.replace("$TOPIC", "").replace("$TABLE", "")))
    t = fx.spark_topics(spark, sf)
    return t.agg(F.max(pr.token_count("query")).alias("max_query_tokens")).select(
        "max_query_tokens", overhead.alias("overhead_tokens"),
        (F.col("max_query_tokens") + overhead).alias("total_tokens"))


@register("sample_exact", """
    SELECT doc_id, quality, toxic FROM labels
    ORDER BY md5(CAST(doc_id AS VARCHAR) || '|' || '42'), doc_id LIMIT 100""")
def sample_exact(spark, sf):
    """Exactly 100 judgements, reproducible for seed 42."""
    return co.sample_exact(table(spark, sf, "labels"), 100, 42, ["doc_id"])


__all__ = ["_rated"]
