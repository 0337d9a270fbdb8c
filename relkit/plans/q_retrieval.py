"""Retrieval queries: index statistics (X1-X5), 21 weighting models (X6, W1),
evaluation (W2-W5, X7, X8, A12) and system comparison (A13, A14, J11, J12).

Topics = v_topics (benchmark), corpus = v_docs (documents), label sets =
v_qrels_a ('human') and v_qrels_b ('llm'), both remapped 2 → 1 as the
reference does before evaluating runs.

The ranking queries read one stored index without its stop terms, but for
``rank_all_models``, which ranks by all terms and has an index with every term.  A
session builds each once a version of the documents table; the queries themselves
only scan the buckets of their terms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.functions.text import TOKEN_SPLIT
from relkit.operators import agreement as ag
from relkit.operators import evaluate as ev
from relkit.operators import fieldindex as fi
from relkit.operators import rankers as rk
from relkit.operators import systems as sy
from relkit.operators import textindex as ti
from relkit.plans import fixtures as fx
from relkit.plans.q_tables import _CLEAN, MULTI_FIELD, multi_field_corpus
from relkit.plans.registry import register
from relkit.session import shared_folder, stored, table_version

K = 1000                       # ranked list depth (the reference's retriever default)
LABEL_SETS = ["human", "llm"]
TAU_METRICS = ["map", "ndcg_cut_10"]
MODELS = rk.MODEL_NAMES
FIELDS = ["page_title", "text_before", "text", "text_after", "header"]
FIELD_WEIGHTS = {"page_title": 3.0, "text_before": 1.0, "text": 1.0, "text_after": 1.0, "header": 2.0}


# ---------------------------------------------------------------- Spark side

_stored: dict[tuple, object] = {}


def _once(spark, sf, name, tables, build):
    """``build()`` of this session and version of its tables, on first use."""
    key = (name, spark.sparkContext.applicationId, *(table_version(spark, f"{sf}/{t}.parquet") for t in tables))
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def _lazy_index(spark, sf):
    return ti.TextIndex.build(fx.spark_docs(spark, sf), "docno", "text")


def _index(spark, sf):
    return _once(spark, sf, "text", ["documents"], lambda: ti.store(_lazy_index(spark, sf), shared_folder(spark, "index")))


def _whole_index(spark, sf):
    """The index with every term of every document."""
    return _once(spark, sf, "whole text", ["documents"],
                 lambda: ti.store(_lazy_index(spark, sf), shared_folder(spark, "index"), stop_percent=100))


def _ranked(spark, sf, models=MODELS, index=_index):
    return rk.retrieve(index(spark, sf), fx.spark_topics(spark, sf), models, K)


def _qrels_eval(spark, sf):
    """Both label sets of a pair from one overlap pass, stored: few pairs share
    enough, and an evaluation reads them three times."""
    both = fx.spark_qrels_both(spark, sf).where("variant = 'bin_len'")
    sets = F.array(*[F.struct(F.lit(s).alias("label_set"), ag.remap_to_bin(c).alias("label"))
                     for s, c in zip(LABEL_SETS, ("human", "label"))])
    return stored(both.select("qid", "docno", F.inline(sets)).select("label_set", "qid", "docno", "label"), "qrels")


def _metrics(spark, sf):
    ranked = _ranked(spark, sf)
    return ev.evaluate(ranked, _qrels_eval(spark, sf), fx.spark_topics(spark, sf), MODELS, LABEL_SETS)


def _metrics_long(spark, sf, metrics=TAU_METRICS):
    m = _metrics(spark, sf)
    return m.unpivot(["label_set", "qid", "model"], list(metrics), "metric", "value")


def _field_index(spark, sf):
    return _once(spark, sf, "fields", ["lineitem", "orders", "customer", "pages"], lambda: fi.FieldIndex.build(
        multi_field_corpus(spark, sf), FIELDS).store(shared_folder(spark, "fields")))


# ---------------------------------------------------------------- SQL side

def _tok(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '{TOKEN_SPLIT}'), lambda t: t <> '')"


_IDX = {
    "d_tok": f"SELECT CAST(doc_id AS VARCHAR) AS docno, {_tok('text')} AS tok FROM documents",
    "d_len": "SELECT docno, CAST(len(tok) AS BIGINT) AS dl FROM d_tok",
    "d_post": """SELECT docno, term, CAST(count(*) AS INTEGER) AS tf
                 FROM (SELECT docno, unnest(tok) AS term FROM d_tok) GROUP BY docno, term""",
    "d_tstat": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM d_post GROUP BY term",
    "d_coll": "SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_tokens FROM d_len",
}
# terms of more than STOP_PERCENT of the documents leave postings, lengths and statistics
_KEPT = {
    "d_stop": f"SELECT term, df FROM d_tstat, d_coll WHERE df * 100 > n_docs * {ti.STOP_PERCENT}",
    "k_post": "SELECT * FROM d_post WHERE term NOT IN (SELECT term FROM d_stop)",
    "k_len": """SELECT l.docno, coalesce(k.dl, 0) AS dl FROM d_len l
                LEFT JOIN (SELECT docno, sum(tf) AS dl FROM k_post GROUP BY docno) k ON k.docno = l.docno""",
    "k_tstat": "SELECT * FROM d_tstat WHERE term NOT IN (SELECT term FROM d_stop)",
    "k_coll": "SELECT count(*) AS n_docs, sum(dl) AS n_tokens FROM k_len",
}


def _log2(x):
    return f"(ln({x}) / ln(2))"


# The published definitions, written from named parts (columns of ``feats``):
# tfn, tfe normalisation 2 with log2 and ln; norm BM25's length normalisation; rel
# the relative frequency in the document, prior that in the collection; expect the
# count expected by length; mean the count a document; once the Bernoulli factor.
_SMOOTH = "((tf + 1) / (dl + 1))"
_CORE = f"tf * {_log2('rel / (mean / avgdl)')} + {_log2('2 * pi() * tf * (1 - rel)')} / 2"
_SQL_MODELS = {
    "TF_IDF": f"qtf * 1.2 * tf / (tf + norm) * {_log2('1 + n_docs / df')}",
    "BM25": f"{_log2('(n_docs - df + 0.5) / (df + 0.5)')} * tf * 2.2 / (tf + norm) * qtf * 9 / (qtf + 8)",
    "DirichletLM": f"qtf * {_log2('(tf + 2500 * prior) / (prior * (2500 + dl))')}",
    "PL2": (f"qtf * (tfn * {_log2('tfn / mean')} + (mean - tfn) / ln(2) + {_log2('2 * pi() * tfn')} / 2)"
            " / (tfn + 1)"),
    "CoordinateMatch": "1",
    "DFIC": f"CASE WHEN tf > expect THEN qtf * {_log2('1 + power(tf - expect, 2) / expect')} ELSE 0 END",
    "DFIZ": f"CASE WHEN tf > expect THEN qtf * {_log2('1 + (tf - expect) / power(expect, 0.5)')} ELSE 0 END",
    "DFRee": (f"qtf * tf * {_log2(f'{_SMOOTH} / rel')} * ((tf + 1) * {_log2(f'{_SMOOTH} / prior')}"
              f" - tf * {_log2('rel / prior')} + {_log2(f'{_SMOOTH} / rel')} / 2)"),
    "Dl": "dl",
    "DLH": (f"CASE WHEN tf < dl THEN qtf / (tf + 0.5) * ({_CORE} + (dl - tf) * {_log2('(dl - tf) / dl')}) ELSE 0 END"),
    "DLH13": f"CASE WHEN tf < dl THEN qtf / (tf + 0.5) * ({_CORE}) ELSE 0 END",
    "DPH": f"CASE WHEN tf < dl THEN qtf * power(1 - rel, 2) / (tf + 1) * ({_CORE}) ELSE 0 END",
    "Hiemstra_LM": f"qtf * {_log2('1 + (0.15 * rel) / (0.85 * prior)')}",
    "IFB2": f"qtf * once / (tfn + 1) * tfn * {_log2('(n_docs + 1) / (cf + 0.5)')}",
    "In_expB2": f"qtf * once / (tfn + 1) * tfn * {_log2('(n_docs + 1) / (0.5 + n_docs - n_docs * exp(-mean))')}",
    "In_expC2": f"qtf * once / (tfe + 1) * tfe * {_log2('(n_docs + 1) / (0.5 + n_docs - n_docs * exp(-mean))')}",
    "InB2": f"qtf * once / (tfn + 1) * tfn * {_log2('(n_docs + 1) / (df + 0.5)')}",
    "InL2": f"qtf * (1 - 1 / (tfn + 1)) * {_log2('(n_docs + 1) / (df + 0.5)')}",
    "LemurTF_IDF": f"qtf * 1.2 * tf / (tf + norm) * {_log2('n_docs / df')} * {_log2('n_docs / df')}",
    "LGD": f"qtf * {_log2('1 + tfn * n_docs / df')}",
    "Tf": "tf",
}

def _matched(of):
    """Postings that match a topic, of the index whose tables begin with ``of``."""
    return f"""SELECT q.qid, p.docno, CAST(p.tf AS DOUBLE) AS tf, CAST(l.dl AS DOUBLE) AS dl, q.qtf,
                       CAST(s.df AS DOUBLE) AS df, CAST(s.cf AS DOUBLE) AS cf,
                       CAST(c.n_docs AS DOUBLE) AS n_docs, CAST(c.n_tokens AS DOUBLE) AS n_tokens,
                       CAST(c.n_tokens AS DOUBLE) / c.n_docs AS avgdl
                FROM {of}_post p JOIN q_terms q ON p.term = q.term JOIN {of}_tstat s ON s.term = p.term
                JOIN {of}_len l ON l.docno = p.docno CROSS JOIN {of}_coll c"""


_RANK = {
    "q_terms": f"""SELECT qid, term, CAST(count(*) AS DOUBLE) AS qtf
                   FROM (SELECT qid, unnest({_tok('query')}) AS term FROM v_topics) GROUP BY qid, term""",
    "matched": _matched("k"),
    "feats": """SELECT *, tf * ln(1 + avgdl / dl) / ln(2) AS tfn, tf * ln(1 + avgdl / dl) AS tfe,
                       0.3 + 0.9 * dl / avgdl AS norm, tf / dl AS rel, cf / n_tokens AS prior,
                       cf / n_tokens * dl AS expect, cf / n_docs AS mean, (cf + 1) / df AS once FROM matched""",
    "scores": "SELECT qid, docno, " + ", ".join(
        f"sum(CAST(round(({_SQL_MODELS[m]}) * 1e10) AS BIGINT)) AS {rk.score_column(m)}" for m in MODELS)
        + " FROM feats GROUP BY qid, docno",
    "stacked": " UNION ALL ".join(
        f"SELECT qid, docno, '{m}' AS model, {rk.score_column(m)} AS points FROM scores"
        for m in MODELS),
    "ranked": f"""SELECT qid, model, docno, CAST(points AS DOUBLE) / 1e10 AS score, rank FROM (
                    SELECT qid, model, docno, points,
                           row_number() OVER (PARTITION BY qid, model ORDER BY points DESC, docno DESC) AS rank
                    FROM stacked) WHERE rank <= {K}""",
}
_EVAL = {
    "qrels_eval": """SELECT 'human' AS label_set, qid, docno, CASE WHEN label = 2 THEN 1 ELSE label END AS label
                     FROM v_qrels_a
                     UNION ALL
                     SELECT 'llm', qid, docno, CASE WHEN label = 2 THEN 1 ELSE label END FROM v_qrels_b""",
    "pos": "SELECT * FROM qrels_eval WHERE label > 0",
    "j": """SELECT r.qid, r.model, r.docno, r.rank, p.label_set, p.label,
                   count(*) OVER (PARTITION BY p.label_set, r.qid, r.model ORDER BY r.rank
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM ranked r JOIN pos p ON r.qid = p.qid AND r.docno = p.docno""",
    "per_run": """SELECT label_set, qid, model, sum(CAST(cum AS DOUBLE) / rank) AS ap_num,
                         count(*) FILTER (WHERE rank <= 5) AS rel5, count(*) FILTER (WHERE rank <= 10) AS rel10,
                         sum(CASE WHEN rank <= 5 THEN label / log2(rank + 1.0) ELSE 0.0 END) AS dcg5,
                         sum(CASE WHEN rank <= 10 THEN label / log2(rank + 1.0) ELSE 0.0 END) AS dcg10
                  FROM j GROUP BY label_set, qid, model""",
    "ideal": """SELECT label_set, qid,
                       sum(CASE WHEN i <= 5 THEN label / log2(i + 1.0) ELSE 0.0 END) AS idcg5,
                       sum(CASE WHEN i <= 10 THEN label / log2(i + 1.0) ELSE 0.0 END) AS idcg10
                FROM (SELECT *, row_number() OVER (PARTITION BY label_set, qid ORDER BY label DESC, docno) AS i
                      FROM pos) WHERE i <= 10 GROUP BY label_set, qid""",
    "nrel": "SELECT label_set, qid, count(*) AS r FROM pos GROUP BY label_set, qid",
    "grid": "SELECT t.qid, s.label_set, m.model FROM v_topics t CROSS JOIN (VALUES "
            + ", ".join(f"('{s}')" for s in LABEL_SETS) + ") s(label_set) CROSS JOIN (VALUES "
            + ", ".join(f"('{m}')" for m in MODELS) + ") m(model)",
    "metrics": """SELECT g.label_set, g.qid, g.model,
                         coalesce(pr.ap_num / n.r, 0.0) AS map,
                         coalesce(pr.rel5 / 5.0, 0.0) AS P_5, coalesce(pr.rel10 / 10.0, 0.0) AS P_10,
                         coalesce(CASE WHEN i.idcg5 > 0 THEN pr.dcg5 / i.idcg5 END, 0.0) AS ndcg_cut_5,
                         coalesce(CASE WHEN i.idcg10 > 0 THEN pr.dcg10 / i.idcg10 END, 0.0) AS ndcg_cut_10
                  FROM grid g
                  LEFT JOIN per_run pr ON pr.label_set = g.label_set AND pr.qid = g.qid AND pr.model = g.model
                  LEFT JOIN nrel n ON n.label_set = g.label_set AND n.qid = g.qid
                  LEFT JOIN ideal i ON i.label_set = g.label_set AND i.qid = g.qid""",
}
_RET_VIEWS = ["v_topics", "v_qrels_a", "v_qrels_b"]


def _sql(body, *groups, views=("v_topics",)):
    ctes = {}
    for g in groups:
        ctes.update(g)
    return fx.sql_with(list(views), body, ctes)


# ---------------------------------------------------------------- index

@register("postings", _sql("SELECT term, docno, tf FROM d_post", _IDX, views=()))
def postings(spark, sf):
    """(term, docno, tf) for every distinct term of every document."""
    return _lazy_index(spark, sf).postings.select("term", "docno", "tf")


@register("term_stats", _sql("SELECT term, df, cf FROM d_tstat", _IDX, views=()))
def term_stats(spark, sf):
    return _lazy_index(spark, sf).term_stats()


@register("doc_stats", _sql("SELECT docno, dl FROM d_len", _IDX, views=()))
def doc_stats(spark, sf):
    return _lazy_index(spark, sf).doc_lengths


@register("coll_stats", _sql(
    "SELECT n_docs, n_tokens, round(CAST(n_tokens AS DOUBLE) / n_docs, 6) AS avgdl FROM d_coll", _IDX, views=()))
def coll_stats(spark, sf):
    return _lazy_index(spark, sf).coll_stats()


@register("stop_terms", _sql("SELECT term, df FROM d_stop", _IDX, _KEPT, views=()))
def stop_terms(spark, sf):
    """Terms of more than STOP_PERCENT of the documents, which ranking leaves out."""
    idx = _lazy_index(spark, sf)
    return ti.stop_terms(idx.term_stats(), idx.doc_lengths.agg(F.count(F.lit(1))).scalar())


@register("index_postings", _sql("SELECT term, docno, tf, dl FROM k_post JOIN k_len USING (docno)", _IDX, _KEPT,
                                 views=()))
def index_postings(spark, sf):
    """The postings of the stored index, without stop terms."""
    return _index(spark, sf).postings.select("term", "docno", "tf", "dl")


_FIELD = {
    **_CLEAN,
    "m_corpus": MULTI_FIELD,
    "f_tok": " UNION ALL ".join(f"SELECT docno, '{f}' AS field, unnest({_tok(f)}) AS term FROM m_corpus" for f in FIELDS),
    "f_tf": "SELECT docno, term, field, count(*) AS tf FROM f_tok GROUP BY docno, term, field",
    "f_len": "SELECT docno, field, count(*) AS n FROM f_tok GROUP BY docno, field",
    "f_df": "SELECT term, count(DISTINCT docno) AS df FROM f_tf GROUP BY term",
    "f_avg": "SELECT field, sum(n) / (SELECT count(*) FROM m_corpus) AS average FROM f_len GROUP BY field",
    "f_weight": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {w!r}::DOUBLE)" for f, w in FIELD_WEIGHTS.items())
                + ") w(field, weight)",
    "f_score": f"""
        SELECT qid, docno, sum(CAST(round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf / ({fi.K1} + wtf) * 1e10)
                               AS BIGINT)) AS points
        FROM (SELECT t.docno, t.term, sum(weight * tf / ({1 - fi.B} + {fi.B} * l.n / average)) AS wtf
              FROM f_tf t JOIN f_len l ON l.docno = t.docno AND l.field = t.field
              JOIN f_avg a ON a.field = t.field JOIN f_weight w ON w.field = t.field GROUP BY t.docno, t.term) x
        JOIN q_terms USING (term) JOIN f_df USING (term) CROSS JOIN (SELECT count(*) AS n FROM m_corpus)
        GROUP BY qid, docno""",
}


@register("fielded_postings", _sql("SELECT term, docno, " + ", ".join(
    f"coalesce(max(CASE WHEN field = '{f}' THEN tf END), 0) AS tf_{f}" for f in FIELDS)
    + " FROM f_tf GROUP BY term, docno", _FIELD, views=("v_web_raw",)))
def fielded_postings(spark, sf):
    """One posting a term and table, with its count in each field."""
    tf = [F.coalesce(F.col("tfs")[f], F.lit(0)).cast("bigint").alias(f"tf_{f}") for f in FIELDS]
    return _field_index(spark, sf).postings.select("term", "docno", *tf)


@register("field_lengths", _sql("""
    SELECT f.field, (SELECT count(*) FROM m_corpus) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens
    FROM f_weight f LEFT JOIN f_len USING (field) GROUP BY f.field""", _FIELD, views=("v_web_raw",)))
def field_lengths(spark, sf):
    """The length of each field over all tables."""
    return _field_index(spark, sf).field_lengths()


@register("rank_bm25f", _sql(f"""
    SELECT * FROM (SELECT qid, docno, round(points / 1e10, 6) AS score,
                          row_number() OVER (PARTITION BY qid ORDER BY points DESC, docno DESC) AS rank
                   FROM f_score WHERE points > 0) WHERE rank <= {K}""", {k: _RANK[k] for k in ("q_terms",)}, _FIELD,
    views=("v_topics", "v_web_raw")))
def rank_bm25f(spark, sf):
    """Tables ranked with field weights."""
    terms = rk.query_terms(fx.spark_topics(spark, sf))
    return fi.rank_fields(fi.score_fields(_field_index(spark, sf), terms, FIELD_WEIGHTS), K)


@register("single_field_corpus", fx.sql_with(["v_docs"], "SELECT docno, text FROM v_docs"))
def single_field_corpus(spark, sf):
    """The (docno, text) corpus the index is built from."""
    return fx.spark_docs(spark, sf)


@register("query_terms", _sql("SELECT qid, term, qtf FROM q_terms", _RANK))
def query_terms(spark, sf):
    return rk.query_terms(fx.spark_topics(spark, sf))


# ---------------------------------------------------------------- ranking

def _register_model(m):
    sql = _sql(f"SELECT qid, docno, round(score, 6) AS score, rank FROM ranked WHERE model = '{m}'", _IDX, _KEPT, _RANK)

    def q(spark, sf):
        return _ranked(spark, sf, [m]).select("qid", "docno", "score", "rank")
    q.__doc__ = f"Top-{K} per topic with the {m} weighting model."
    register("rank_" + m.lower(), sql)(q)


for _m in MODELS:
    _register_model(_m)


@register("rank_all_models", _sql("SELECT qid, model, docno, round(score, 6) AS score, rank FROM ranked",
                                  _IDX, _RANK | {"matched": _matched("d")}))
def rank_all_models(spark, sf):
    """All 21 models in one scoring pass: top-1000 per (topic, model), by all terms of
    the topics, those of many documents among them."""
    ranked = _ranked(spark, sf, index=_whole_index)
    # as the SQL rounds: the product, halves of it away from zero
    score = F.signum("score") * F.floor(F.abs("score") * 1e6 + 0.5) / 1e6
    return ranked.select("qid", "model", "docno", score.alias("score"), "rank")


# ---------------------------------------------------------------- evaluation

def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register("average_precision", _sql(f"SELECT label_set, qid, model, {_r6(['map'])} FROM metrics",
                                    _IDX, _KEPT, _RANK, _EVAL, views=_RET_VIEWS))
def average_precision(spark, sf):
    return _metrics(spark, sf).select("label_set", "qid", "model", "map")


@register("precision_at_k", _sql(f"SELECT label_set, qid, model, {_r6(['P_5', 'P_10'])} FROM metrics",
                                 _IDX, _KEPT, _RANK, _EVAL, views=_RET_VIEWS))
def precision_at_k(spark, sf):
    return _metrics(spark, sf).select("label_set", "qid", "model", "P_5", "P_10")


@register("ndcg_at_k", _sql(f"SELECT label_set, qid, model, {_r6(['ndcg_cut_5', 'ndcg_cut_10'])} FROM metrics",
                            _IDX, _KEPT, _RANK, _EVAL, views=_RET_VIEWS))
def ndcg_at_k(spark, sf):
    return _metrics(spark, sf).select("label_set", "qid", "model", "ndcg_cut_5", "ndcg_cut_10")


@register("evaluate_runs", _sql(f"SELECT label_set, qid, model, {_r6(ev.METRICS)} FROM metrics",
                                _IDX, _KEPT, _RANK, _EVAL, views=_RET_VIEWS))
def evaluate_runs(spark, sf):
    """Experiment: 21 rankers × all topics × 5 measures × 2 label sets, one plan."""
    return _metrics(spark, sf)


@register("map_per_model", _sql(
    "SELECT label_set, model, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ev.METRICS)
    + " FROM metrics GROUP BY label_set, model", _IDX, _KEPT, _RANK, _EVAL, views=_RET_VIEWS))
def map_per_model(spark, sf):
    return ev.mean_per_model(_metrics(spark, sf))


# ---------------------------------------------------------------- system comparison

_SYS = {
    "mlong": " UNION ALL ".join(f"SELECT label_set, qid, model, '{c}' AS metric, {c} AS value FROM metrics"
                                for c in TAU_METRICS),
    "means": """SELECT metric, model,
                       round(avg(value) FILTER (WHERE label_set = 'human'), 9) AS x,
                       round(avg(value) FILTER (WHERE label_set = 'llm'), 9) AS y
                FROM mlong GROUP BY metric, model""",
    "tau": """SELECT a.metric, count(*) AS n_pairs,
                     sum(sign(a.x - b.x) * sign(a.y - b.y))
                       / sqrt(CAST(count(*) FILTER (WHERE a.x <> b.x) AS DOUBLE)
                              * count(*) FILTER (WHERE a.y <> b.y)) AS tau
              FROM means a JOIN means b ON a.metric = b.metric AND a.model < b.model GROUP BY a.metric""",
    "pairs": """SELECT a.label_set, a.metric, a.model AS model_a, b.model AS model_b, a.value - b.value AS d
                FROM mlong a JOIN mlong b
                  ON a.label_set = b.label_set AND a.metric = b.metric AND a.qid = b.qid AND a.model < b.model""",
    "tstats": """SELECT label_set, metric, model_a, model_b, count(*) AS n, avg(d) AS mean_d, stddev_samp(d) AS sd_d
                 FROM pairs GROUP BY ALL""",
}


@register("kendall_tau_models", _sql("SELECT metric, n_pairs, round(tau, 6) AS tau FROM tau",
                                     _IDX, _KEPT, _RANK, _EVAL, _SYS, views=_RET_VIEWS))
def kendall_tau_models(spark, sf):
    """Kendall's tau-b between the model orderings (mean MAP / nDCG@10) under
    human and LLM labels."""
    m = _metrics_long(spark, sf)
    means = m.groupBy("metric", "model").agg(
        F.avg(F.when(F.col("label_set") == "human", F.col("value"))).alias("x"),
        F.avg(F.when(F.col("label_set") == "llm", F.col("value"))).alias("y"))
    return sy.kendall_tau(means, "x", "y", by=["metric"])


@register("paired_ttest_stats", _sql(
    """SELECT label_set, metric, model_a, model_b, n, round(mean_d, 6) AS mean_d, round(sd_d, 6) AS sd_d,
              round(CASE WHEN sd_d > 0 THEN mean_d / (sd_d / sqrt(n))
                         WHEN mean_d > 0 THEN 'inf'::DOUBLE WHEN mean_d < 0 THEN '-inf'::DOUBLE END, 6) AS t
       FROM tstats""", _IDX, _KEPT, _RANK, _EVAL, _SYS, views=_RET_VIEWS))
def paired_ttest_stats(spark, sf):
    return sy.paired_ttest_stats(_metrics_long(spark, sf), ["label_set", "metric"])


# The oracle's p-value: the share of cos^(dof - 1) beyond the angle of t, by
# Simpson's rule (the Spark side sums a finite series).
_STEPS = 2000
_PVALUE = {
    "tcase": """SELECT *, n - 1 AS dof, CASE WHEN sd_d > 0 THEN atan(abs(mean_d / (sd_d / sqrt(n))) / sqrt(n - 1))
                                            WHEN mean_d <> 0 THEN pi() / 2 END AS angle FROM tstats""",
    "simpson": f"""SELECT i / {_STEPS}.0 AS u, CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
                   FROM (SELECT unnest(range({_STEPS} + 1)) AS i)""",
    "tvalue": """SELECT label_set, metric, model_a, model_b, any_value(n) AS n,
                        greatest(0, 1 - sum(w * power(greatest(0, cos(angle * u)), dof - 1)) * any_value(angle)
                                        / (sum(w * power(greatest(0, cos(pi() / 2 * u)), dof - 1)) * pi() / 2)) AS p
                 FROM tcase CROSS JOIN simpson WHERE dof >= 1 GROUP BY label_set, metric, model_a, model_b""",
}


@register("ttest_pvalues", _sql("SELECT label_set, metric, model_a, model_b, n, round(p, 6) AS p FROM tvalue",
                                _IDX, _KEPT, _RANK, _EVAL, _SYS, _PVALUE, views=_RET_VIEWS))
def ttest_pvalues(spark, sf):
    """Two-sided p-value of every paired t-test."""
    p = sy.ttest_pvalues(_metrics_long(spark, sf), ["label_set", "metric"])
    return p.select("label_set", "metric", "model_a", "model_b", "n", "p")


@register("sensitivity", _sql("""
    SELECT label_set, metric, count(*) AS n_pairs, count(*) FILTER (WHERE p < 0.05) AS n_significant,
           round_even(CAST(count(*) FILTER (WHERE p < 0.05) AS DOUBLE) / count(*), 2) AS sensitivity
    FROM tvalue GROUP BY label_set, metric""", _IDX, _KEPT, _RANK, _EVAL, _SYS, _PVALUE, views=_RET_VIEWS))
def sensitivity(spark, sf):
    """Share of model pairs a paired t-test separates at p < 0.05."""
    return sy.sensitivity(_metrics_long(spark, sf), ["label_set", "metric"])

