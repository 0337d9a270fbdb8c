"""Weighting models (X6) and ranking.

Every model is a per-term score written as one SQL expression over the
columns tf, dl, qtf, df, cf, n_docs, n_tokens, avgdl (all DOUBLE).  All models
are evaluated and summed over the matched postings in ONE aggregation per
(qid, docno) -- the postings are read once for all models.

Formulas: the published forms (Robertson BM25; Zhai & Lafferty Dirichlet;
Hiemstra LM; Amati & van Rijsbergen DFR; Amati DLH/DPH; Clinchant & Gaussier
LGD; Kocabas et al. DFI) with the customary parameters (k1=1.2, b=0.75, k3=8,
mu=2500, lambda=0.15, c=1).  The DPH/DLH family gives 0 where a document is a
single repeated term (tf = dl), for which its logarithm is undefined.

Tie rule: the score of a term is taken in whole units of 1e-10 and these are
summed, so the sum does not depend on the order of terms, and documents with
the same counts tie exactly; ties go by docno, descending.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relkit.functions.text import tokenize
from relkit.operators.textindex import StoredIndex, bucket_of
from relkit.session import stored

#: Units of a term's score in one point.
UNITS = 1e10
#: Doubles from here on are whole.
EXACT = 2.0 ** 52

# DFR term-frequency normalisation 2 (c = 1), base-2 and natural-log forms
_TFN = "(tf * log2(1.0 + avgdl / dl))"
_TFE = "(tf * ln(1.0 + avgdl / dl))"
_ROB_TF = "(1.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))"
_EXP = "(cf * dl / n_tokens)"
_F = "(tf / dl)"
_DLH_CORE = (f"(tf * log2((tf * avgdl / dl) * (n_docs / cf)) "
             f"+ 0.5 * log2(2.0 * pi() * tf * (1.0 - {_F})))")

# Model name -> per-term score.
MODELS: dict[str, str] = {
    "TF_IDF": f"qtf * {_ROB_TF} * log2(n_docs / df + 1.0)",
    "BM25": ("log2((n_docs - df + 0.5) / (df + 0.5)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))"
             " * (9.0 * qtf / (8.0 + qtf))"),
    "DirichletLM": "qtf * (log2(1.0 + tf / (2500.0 * cf / n_tokens)) + log2(2500.0 / (dl + 2500.0)))",
    "PL2": (f"qtf / ({_TFN} + 1.0) * ({_TFN} * log2(n_docs / cf) + (cf / n_docs) * log2(exp(1.0))"
            f" + 0.5 * log2(2.0 * pi() * {_TFN}) + {_TFN} * (log2({_TFN}) - log2(exp(1.0))))"),
    "CoordinateMatch": "1.0",
    "DFIC": f"CASE WHEN tf <= {_EXP} THEN 0.0 ELSE qtf * log2((tf - {_EXP}) * (tf - {_EXP}) / {_EXP} + 1.0) END",
    "DFIZ": f"CASE WHEN tf <= {_EXP} THEN 0.0 ELSE qtf * log2((tf - {_EXP}) / sqrt({_EXP}) + 1.0) END",
    "DFRee": ("qtf * (tf * log2(((tf + 1.0) / (dl + 1.0)) / (tf / dl)))"
              " * (-tf * log2((tf / dl) * (n_tokens / cf))"
              " + (tf + 1.0) * log2(((tf + 1.0) / (dl + 1.0)) * (n_tokens / cf))"
              " + 0.5 * log2(((tf + 1.0) / (dl + 1.0)) / (tf / dl)))"),
    "Dl": "dl",
    "DLH": (f"CASE WHEN tf < dl THEN qtf * (tf * log2((tf * avgdl / dl) * (n_docs / cf))"
            f" + (dl - tf) * log2(1.0 - {_F}) + 0.5 * log2(2.0 * pi() * tf * (1.0 - {_F}))) / (tf + 0.5)"
            f" ELSE 0.0 END"),
    "DLH13": f"CASE WHEN tf < dl THEN qtf * {_DLH_CORE} / (tf + 0.5) ELSE 0.0 END",
    "DPH": (f"CASE WHEN tf < dl THEN qtf * (1.0 - {_F}) * (1.0 - {_F}) / (tf + 1.0) * {_DLH_CORE}"
            f" ELSE 0.0 END"),
    "Hiemstra_LM": "qtf * log2(1.0 + 0.15 * tf * n_tokens / (0.85 * cf * dl))",
    "IFB2": f"qtf * {_TFN} * (cf + 1.0) / (df * ({_TFN} + 1.0)) * log2((n_docs + 1.0) / (cf + 0.5))",
    "In_expB2": (f"qtf * {_TFN} * (cf + 1.0) / (df * ({_TFN} + 1.0))"
                 f" * log2((n_docs + 1.0) / (n_docs * (1.0 - exp(-cf / n_docs)) + 0.5))"),
    "In_expC2": (f"qtf * {_TFE} * (cf + 1.0) / (df * ({_TFE} + 1.0))"
                 f" * log2((n_docs + 1.0) / (n_docs * (1.0 - exp(-cf / n_docs)) + 0.5))"),
    "InB2": f"qtf * {_TFN} * (cf + 1.0) / (df * ({_TFN} + 1.0)) * log2((n_docs + 1.0) / (df + 0.5))",
    "InL2": f"qtf * {_TFN} / ({_TFN} + 1.0) * log2((n_docs + 1.0) / (df + 0.5))",
    "LemurTF_IDF": f"qtf * {_ROB_TF} * power(log2(n_docs / df), 2)",
    "LGD": f"qtf * log2((df / n_docs + {_TFN}) / (df / n_docs))",
    "Tf": "tf",
}

# Named by the reference but without a formula we could verify from a
# published source: not built (see README).
OMITTED_MODELS = ("DFR_BM25", "DFReeKLIM", "Js_KLs")

MODEL_NAMES = list(MODELS)


def score_column(model: str) -> str:
    return "s_" + model.lower()


def units(score: Column, per_point: float = UNITS) -> Column:
    """A score in whole units, halves away from zero; ``round`` goes through a decimal a value."""
    x = score * per_point
    whole = F.signum(x) * F.floor(F.abs(x) + 0.5)
    return F.when(F.abs(x) < EXACT, whole).otherwise(x).cast("bigint")


def query_terms(topics: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, term, qtf) from the query text."""
    t = topics.select(F.col(qid).alias("qid"), F.explode(tokenize(query)).alias("term"))
    return t.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))


def indexed_terms(index: StoredIndex, qterms: DataFrame) -> DataFrame:
    """(bucket, term, qid, qtf, df, cf) of the query terms in the index, stored: as
    small as the topics are, with a size that the planner knows."""
    q = qterms.where(F.length("term") > 0).withColumn("bucket", bucket_of("term", index.buckets))
    return stored(q.join(index.terms, ["bucket", "term"]), "query-terms")


def matched_features(index: StoredIndex, q: DataFrame, share: int = 1) -> DataFrame:
    """(qid, docno, tf, dl, qtf, df, cf, n_docs, n_tokens, avgdl) for every
    posting of a term of ``q`` (``indexed_terms``), in one of ``share`` documents.
    Both joins are on (bucket, term): where the side of the query terms is
    broadcast, only its buckets are scanned; the choice is the planner's.  The
    postings of a document lie apart and are dealt by docno once, before each is
    matched with the topics of its term: pairs of topic and document are then
    summed where they arise and are not shuffled."""
    q = q.where(F.length("term") > 0)
    cs = index.coll_scalar()
    spark = index.spark
    m = index.postings
    if share > 1:
        m = m.where(F.pmod(F.xxhash64("docno"), F.lit(share)) == 0)
    m = m.join(q.select("bucket", "term").distinct(), ["bucket", "term"])
    # a number of partitions of its own: few postings become many pairs
    m = m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "docno")
    return m.join(q, ["bucket", "term"]).select(
        "qid", "docno", *[F.col(c).cast("double").alias(c) for c in ("tf", "dl", "qtf", "df", "cf")],
        cs["n_docs"].alias("n_docs"), cs["n_tokens"].alias("n_tokens"), (cs["n_tokens"] / cs["n_docs"]).alias("avgdl"))


def score(index: StoredIndex, q: DataFrame, models: Sequence[str] = MODEL_NAMES, share: int = 1) -> DataFrame:
    """(qid, docno, s_<model>...) summed over matching terms, all models in
    one aggregation; ``q`` and ``share`` as in ``matched_features``."""
    feats = matched_features(index, q, share)
    # computed inside its sum, each model is a method of its own in the generated code; all in
    # one projection are a single method, too long for the JVM to compile
    return feats.groupBy("qid", "docno").agg(
        *[(F.sum(units(F.expr(MODELS[m]))) / UNITS).alias(score_column(m)) for m in models])


def rank(scored: DataFrame, models: Sequence[str] = MODEL_NAMES, k: int = 1000,
         floors: DataFrame | None = None) -> DataFrame:
    """Top-k per (qid, model) as (qid, model, docno, score, rank), ties by docno
    descending.  ``row_number <= k`` is planned as WindowGroupLimit: each map task
    keeps only its local top-k per group before the shuffle, so a topic matching a
    third of the corpus still moves at most k rows per task.  Scores below
    ``floors`` (qid, floors struct of a score a model) leave before they are sorted."""
    def entry(m: str):
        row = F.struct(F.lit(m).alias("model"), F.col(score_column(m)).alias("score"))
        if floors is None:
            return row
        return F.when(~F.coalesce(F.col(score_column(m)) < F.col("floors")[m], F.lit(False)), row)

    if floors is not None:
        scored = scored.join(floors, "qid", "left")
    entries = F.array(*map(entry, models))
    stacked = scored.select("qid", "docno", F.inline(entries if floors is None else F.array_compact(entries)))
    w = Window.partitionBy("qid", "model").orderBy(F.col("score").desc(), F.col("docno").desc())
    return (stacked.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def retrieve(index: StoredIndex, topics: DataFrame, models: Sequence[str] = MODEL_NAMES,
             k: int = 1000) -> DataFrame:
    """The ``k`` best documents of every topic and model.  One in ``share`` documents
    is ranked first: the k-th score among those is at most the k-th of all, so nothing
    below it is sorted.  That leaves about n / share and k * share of a topic's n
    documents to be sorted, least at the root of n / k, with n taken as a fifth of the
    corpus (the topics' usual part) or, where it is more, as the documents of the topics'
    commonest term (another n changes the time only)."""
    q = indexed_terms(index, query_terms(topics))
    n = max(index.collection.first().n_docs // 5, q.agg(F.max("df")).first()[0] or 0)
    floors, share = None, math.isqrt(n // k)
    if share > 1:
        last = rank(score(index, q, models, share), models, k).where(F.col("rank") == k)
        # one row a model; a struct, as in a map all models are searched for every score
        each = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models]
        floors = stored(last.groupBy("qid").agg(F.struct(*each).alias("floors")), "floors")
    return rank(score(index, q, models), models, k, floors)
