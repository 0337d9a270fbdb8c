"""Agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.operators import agreement as ag
from relkit.plans import fixtures as fx
from relkit.plans.registry import register
from relkit.plans.sqlgen import kappa_ctes
from relkit.session import table

FIELDS = fx.RATER_FIELDS


def _qrels_pairs(spark, sf):
    """(qid, docno, human graded 0/1/2, pred binary)."""
    both = fx.spark_qrels_both(spark, sf).where(F.col("variant") == "bin_len")
    return both.select("qid", "docno", "human", F.col("label").alias("pred"))


def _qrels_pairs_bin(spark, sf):
    return _qrels_pairs(spark, sf).withColumn("human", ag.binarize("human"))


def _rater(spark, sf, rater):
    return fx.spark_rater_long(spark, sf).where(F.col("rater") == rater).drop("rater")


QP = {"qp": """SELECT a.qid, a.docno, a.label AS human, b.label AS pred
               FROM v_qrels_a a JOIN v_qrels_b b ON a.qid = b.qid AND a.docno = b.docno""",
      "qpb": """SELECT qid, docno, CASE WHEN human > 0 THEN 1 WHEN human = 0 THEN 0 END AS human, pred
                FROM qp"""}
QV = ["v_qrels_a", "v_qrels_b"]


def _kappa_sql(views, pairs_ctes, pairs, by=(), a="human", b="pred", cols=None):
    k = kappa_ctes(pairs, a, b, by)
    byp = "".join(f"{c}, " for c in by)
    sel = cols or f"{byp}n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa"
    return fx.sql_with(views, f"SELECT {sel} FROM k_kappa", {**pairs_ctes, **k})


# ---------------------------------------------------------------- kappa

@register("cohen_kappa_labels", _kappa_sql(
    [], {"lp": "SELECT quality AS human, toxic AS pred FROM labels"}, "lp"))
def cohen_kappa_labels(spark, sf):
    """κ between the two label columns of ``labels`` (quality vs toxic)."""
    lab = table(spark, sf, "labels").select(F.col("quality").alias("human"), F.col("toxic").alias("pred"))
    return ag.cohen_kappa(lab)


@register("cohen_kappa", _kappa_sql(QV, QP, "qpb"))
def cohen_kappa(spark, sf):
    """Binary κ: human labels coded 0 / >0 against binary LLM labels."""
    return ag.cohen_kappa(_qrels_pairs_bin(spark, sf))


@register("cohen_kappa_graded", _kappa_sql(QV, QP, "qp"))
def cohen_kappa_graded(spark, sf):
    """κ over the union of graded human and binary LLM labels (the notebook's
    'binary section' variant that keeps human labels graded)."""
    return ag.cohen_kappa(_qrels_pairs(spark, sf))


@register("kappa_by_topic", _kappa_sql(QV, QP, "qpb", by=["qid"]))
def kappa_by_topic(spark, sf):
    return ag.cohen_kappa(_qrels_pairs_bin(spark, sf), by=["qid"])


@register("kappa_by_variant", _kappa_sql(
    ["v_qrels_a", "v_qrels_llm"],
    {"vp": """SELECT v.variant, a.qid, a.docno,
                     CASE WHEN v.graded THEN a.label
                          WHEN a.label > 0 THEN 1 WHEN a.label = 0 THEN 0 END AS human,
                     v.label AS pred
              FROM v_qrels_a a JOIN v_qrels_llm v ON a.qid = v.qid AND a.docno = v.docno"""},
    "vp", by=["variant"]))
def kappa_by_variant(spark, sf):
    """κ per prompt variant from one overlap pass; graded variants compare raw
    human labels, binary ones the binarized human labels."""
    p = fx.spark_qrels_both(spark, sf).select(
        "variant", "qid", "docno",
        F.when(F.col("graded"), F.col("human")).otherwise(ag.binarize("human")).alias("human"),
        F.col("label").alias("pred"))
    return ag.cohen_kappa(p, by=["variant"])


@register("kappa_per_field", _kappa_sql(
    ["v_rater_long"],
    {"fp": """SELECT h.doc_id, h.field, h.label AS human, m.label AS pred
              FROM v_rater_long h JOIN v_rater_long m
                ON h.doc_id = m.doc_id AND h.field = m.field AND h.rater = 'human' AND m.rater = 'llm'"""},
    "fp", by=["field"]))
def kappa_per_field(spark, sf):
    """Human vs LLM κ for every judged field in one pass (by=field)."""
    p = ag.pair_labels(_rater(spark, sf, "human"), _rater(spark, sf, "llm"), ["doc_id", "field"])
    return ag.cohen_kappa(p, by=["field"])


_PAIR_CTES = {"rl": "SELECT doc_id, field, label FROM v_rater_long WHERE rater = 'llm'",
              "pp": """SELECT a.field AS field_a, b.field AS field_b, a.label AS la, b.label AS lb
                       FROM rl a JOIN rl b ON a.doc_id = b.doc_id"""}


def _pair_matrix_sql(body_cols=None, outer=None):
    k = kappa_ctes("pp", "la", "lb", ["field_a", "field_b"])
    ctes = {**_PAIR_CTES, **k}
    if outer is None:
        return fx.sql_with(["v_rater_long"],
                           "SELECT field_a, field_b, n, round(kappa, 6) AS kappa FROM k_kappa", ctes)
    return fx.sql_with(["v_rater_long"], outer, ctes)


@register("kappa_pair_matrix", _pair_matrix_sql())
def kappa_pair_matrix(spark, sf):
    return ag.kappa_pair_matrix(_rater(spark, sf, "llm"), ["doc_id"], FIELDS)


@register("kappa_matrix_wide", _pair_matrix_sql(outer="SELECT field_a, " + ", ".join(
    f"round(max(CASE WHEN field_b = '{f}' THEN kappa END), 6) AS {f}" for f in FIELDS)
    + " FROM k_kappa GROUP BY field_a"))
def kappa_matrix_wide(spark, sf):
    return ag.kappa_matrix_wide(ag.kappa_pair_matrix(_rater(spark, sf, "llm"), ["doc_id"], FIELDS), FIELDS)


_POS = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FIELDS))


@register("kappa_lower_mean", _pair_matrix_sql(outer=f"""
    SELECT CAST(count(*) AS BIGINT) AS n_pairs, round(avg(kappa), 6) AS mean_kappa FROM k_kappa
    WHERE (CASE field_a {_POS} END) > (CASE field_b {_POS} END)"""))
def kappa_lower_mean(spark, sf):
    return ag.kappa_lower_mean(ag.kappa_pair_matrix(_rater(spark, sf, "llm"), ["doc_id"], FIELDS), FIELDS)


@register("kappa_between_flag", _pair_matrix_sql(outer="""
    SELECT field_a, field_b, n, round(kappa, 6) AS kappa, kappa BETWEEN 0.25 AND 0.40 AS in_band FROM k_kappa"""))
def kappa_between_flag(spark, sf):
    return ag.kappa_between_flag(ag.kappa_pair_matrix(_rater(spark, sf, "llm"), ["doc_id"], FIELDS))


@register("kappa_pooled", _kappa_sql(
    ["v_rater_long"],
    {"plp": """SELECT h.label AS a_label, m.label AS b_label
                FROM v_rater_long h JOIN v_rater_long m
                  ON h.doc_id = m.doc_id AND h.field = m.field AND h.rater = 'human' AND m.rater = 'llm'"""},
    "plp", a="a_label", b="b_label"))
def kappa_pooled(spark, sf):
    """κ over the ratings of all fields stacked into one pair list."""
    return ag.pooled_kappa(_rater(spark, sf, "human"), _rater(spark, sf, "llm"), ["doc_id"], FIELDS)


# ---------------------------------------------------------------- Fleiss

@register("fleiss_kappa", fx.sql_with(["v_rater_long"], """
    SELECT CAST(count(*) AS BIGINT) AS n_subjects, CAST(sum(k) AS BIGINT) AS n_ratings,
           round(avg(p_i), 6) AS p_bar, round(max(pe), 6) AS p_e,
           round((avg(p_i) - max(pe)) / (1 - max(pe)), 6) AS kappa
    FROM per_subj, pe_t""", {
    "cnt": """SELECT doc_id, label, count(*) AS nij FROM v_rater_long
              WHERE rater = 'llm' AND label IS NOT NULL GROUP BY ALL""",
    "per_subj": """SELECT doc_id, sum(nij) AS k,
                          CAST(sum(nij * nij) - sum(nij) AS DOUBLE) / (sum(nij) * (sum(nij) - 1)) AS p_i
                   FROM cnt GROUP BY doc_id""",
    "per_lab": "SELECT label, CAST(sum(nij) AS DOUBLE) AS sj FROM cnt GROUP BY label",
    "pe_t": "SELECT sum(sj * sj) / (sum(sj) * sum(sj)) AS pe FROM per_lab"}))
def fleiss_kappa(spark, sf):
    """Fleiss' κ with the five LLM-judged fields as raters of each document."""
    return ag.fleiss_kappa(_rater(spark, sf, "llm"), ["doc_id"])


@register("subject_category_counts", fx.sql_with(["v_rater_long"], """
    SELECT doc_id, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_0,
           CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_1,
           CAST(count(*) FILTER (WHERE label NOT IN (0, 1)) AS BIGINT) AS n_other
    FROM v_rater_long WHERE rater = 'llm' AND label IS NOT NULL GROUP BY doc_id"""))
def subject_category_counts(spark, sf):
    return ag.subject_category_counts(_rater(spark, sf, "llm"), ["doc_id"], labels=(0, 1))


# ---------------------------------------------------------------- confusion

@register("confusion_long", fx.sql_with(QV, "SELECT human, pred, n FROM k_conf",
                                        {**QP, **kappa_ctes("qp")}))
def confusion_long(spark, sf):
    return ag.confusion_long(_qrels_pairs(spark, sf))


@register("crosstab_observed", fx.sql_with(QV, """
    SELECT x.human, y.pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM (SELECT DISTINCT human FROM qp) x CROSS JOIN (SELECT DISTINCT pred FROM qp) y
    LEFT JOIN (SELECT human, pred, count(*) AS n FROM qp GROUP BY ALL) c
      ON c.human = x.human AND c.pred = y.pred""", QP))
def crosstab_observed(spark, sf):
    return ag.crosstab(_qrels_pairs(spark, sf))


@register("confusion_wide", fx.sql_with(QV, """
    SELECT pred,
           CAST(sum(CASE WHEN human = 0 THEN n ELSE 0 END) AS BIGINT) AS human_0,
           CAST(sum(CASE WHEN human = 1 THEN n ELSE 0 END) AS BIGINT) AS human_1,
           CAST(sum(CASE WHEN human = 2 THEN n ELSE 0 END) AS BIGINT) AS human_2,
           CAST(sum(CASE WHEN human NOT IN (0, 1, 2) THEN n ELSE 0 END) AS BIGINT) AS human_other
    FROM k_conf GROUP BY pred HAVING sum(n) > 0""", {**QP, **kappa_ctes("qp")}))
def confusion_wide(spark, sf):
    return ag.confusion_wide(ag.confusion_long(_qrels_pairs(spark, sf)), labels=(0, 1, 2))


_FIELD_PAIRS = {"fp": """SELECT h.doc_id, h.field, h.label AS human, m.label AS pred
                         FROM v_rater_long h JOIN v_rater_long m
                           ON h.doc_id = m.doc_id AND h.field = m.field
                          AND h.rater = 'human' AND m.rater = 'llm'"""}


@register("confusion_by_field", fx.sql_with(["v_rater_long"], "SELECT field, human, pred, n FROM k_conf",
                                            {**_FIELD_PAIRS, **kappa_ctes("fp", by=["field"])}))
def confusion_by_field(spark, sf):
    """One confusion matrix per judged field, in one pass."""
    p = ag.pair_labels(_rater(spark, sf, "human"), _rater(spark, sf, "llm"), ["doc_id", "field"])
    return ag.confusion_long(p, by=["field"])


@register("row_max_flag", fx.sql_with(QV, """
    SELECT human, pred, n, n = max(n) OVER (PARTITION BY pred) AS is_row_max FROM k_conf""",
    {**QP, **kappa_ctes("qp")}))
def row_max_flag(spark, sf):
    return ag.row_max_flag(ag.confusion_long(_qrels_pairs(spark, sf)))


@register("label_frequencies", fx.sql_with(QV, """
    SELECT rater, label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY rater), 6) AS share
    FROM (SELECT rater, label, count(*) AS n FROM (
            SELECT 'human' AS rater, human AS label FROM qp UNION ALL SELECT 'pred', pred FROM qp)
          WHERE label IS NOT NULL GROUP BY ALL)""", QP))
def label_frequencies(spark, sf):
    return ag.label_frequencies(_qrels_pairs(spark, sf), ["human", "pred"])


@register("judgement_counts", fx.sql_with(["v_qrels_a"], """
    SELECT count(*) AS n, count(DISTINCT qid) AS n_topics, count(DISTINCT docno) AS n_items FROM v_qrels_a"""))
def judgement_counts(spark, sf):
    """A10: judgements, distinct topics and distinct items of a label set."""
    return ag.judgement_counts(fx.spark_qrels_a(spark, sf), "qid", "docno")


@register("error_rates", fx.sql_with(QV, """
    SELECT axis, label, CAST(n AS BIGINT) AS n, CAST(n_diff AS BIGINT) AS n_diff,
           round(CAST(n_diff AS DOUBLE) / n, 6) AS rate
    FROM (SELECT 'by_pred' AS axis, pred AS label, count(*) AS n, count(*) FILTER (WHERE human <> pred) AS n_diff
          FROM qpb WHERE human IS NOT NULL AND pred IS NOT NULL GROUP BY pred
          UNION ALL
          SELECT 'by_human', human, count(*), count(*) FILTER (WHERE human <> pred)
          FROM qpb WHERE human IS NOT NULL AND pred IS NOT NULL GROUP BY human)""", QP))
def error_rates(spark, sf):
    return ag.error_rates(_qrels_pairs_bin(spark, sf))


@register("positive_diff", fx.sql_with(QV, """
    SELECT CAST(count(*) FILTER (WHERE pred = 1) AS BIGINT) AS n_pred_pos,
           CAST(count(*) FILTER (WHERE human = 1) AS BIGINT) AS n_human_pos,
           CAST(count(*) FILTER (WHERE pred = 1) - count(*) FILTER (WHERE human = 1) AS BIGINT) AS diff
    FROM qpb""", QP))
def positive_diff(spark, sf):
    return ag.positive_diff(_qrels_pairs_bin(spark, sf))


# ---------------------------------------------------------------- recoding / pairing

@register("binarize_labels", fx.sql_with(["v_qrels_a"], """
    SELECT qid, docno, label, CASE WHEN label > 0 THEN 1 WHEN label = 0 THEN 0 END AS label_bin FROM v_qrels_a"""))
def binarize_labels(spark, sf):
    return fx.spark_qrels_a(spark, sf).withColumn("label_bin", ag.binarize("label"))


@register("remap_labels", fx.sql_with(["v_qrels_a"], """
    SELECT qid, docno, label, CASE WHEN label = 2 THEN 1 ELSE label END AS label_remap FROM v_qrels_a"""))
def remap_labels(spark, sf):
    return fx.spark_qrels_a(spark, sf).withColumn("label_remap", ag.remap_to_bin("label"))


@register("clamp_labels", fx.sql_with(["v_qrels_a"], """
    SELECT qid, docno, label, CASE WHEN label > 1 THEN 1 ELSE label END AS label_clamp FROM v_qrels_a"""))
def clamp_labels(spark, sf):
    return fx.spark_qrels_a(spark, sf).withColumn("label_clamp", ag.clamp_labels("label"))


@register("pair_labels_by_key", fx.sql_with(QV, "SELECT qid, docno, human, pred FROM qp", QP))
def pair_labels_by_key(spark, sf):
    return _qrels_pairs(spark, sf)


@register("field_judgements_pivot", fx.sql_with(["v_rater_long"], "SELECT doc_id, " + ", ".join(
    f"max(CASE WHEN field = '{f}' THEN label END) AS {f}" for f in FIELDS)
    + " FROM v_rater_long WHERE rater = 'llm' GROUP BY doc_id"))
def field_judgements_pivot(spark, sf):
    """Per judged document, the label of every field (replaces N+1 lookups)."""
    return ag.pivot_fields(_rater(spark, sf, "llm"), ["doc_id"], FIELDS)


@register("unpivot_fields", """
    SELECT doc_id, 'quality' AS field, quality AS label FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""")
def unpivot_fields(spark, sf):
    return ag.unpivot_fields(table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


@register("label_union", fx.sql_with(QV, """
    SELECT DISTINCT l AS label FROM (SELECT human AS l FROM qp UNION ALL SELECT pred FROM qp)""", QP))
def label_union(spark, sf):
    """Category union of two raters (sorted union of observed labels)."""
    p = _qrels_pairs(spark, sf)
    return p.select(F.col("human").alias("label")).union(p.select(F.col("pred").alias("label"))).distinct()
