"""Ranked-list evaluation (W2-W5, X7, X8, A12): AP, P@k, nDCG@k per
(label_set, qid, model), then means per model.

Semantics (trec_eval conventions): the ranking is by score desc, docno desc
(``rank`` from ``rankers.rank``); relevant = label > 0; AP divides by all
relevant documents of the topic (retrieved or not) and is 0 without any;
P@k always divides by k; nDCG@k uses the label as gain with log2(rank+1)
discount, ideal from the qrels of the topic; 0 when the ideal DCG is 0.
Every (label_set, topic, model) appears, with zeros when nothing relevant
was retrieved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("map", "P_5", "P_10", "ndcg_cut_5", "ndcg_cut_10")


def evaluate(ranked: DataFrame, qrels: DataFrame, topics: DataFrame,
             models: Sequence[str], label_sets: Sequence[str],
             cutoffs: Sequence[int] = (5, 10)) -> DataFrame:
    """ranked(qid, model, docno, rank); qrels(label_set, qid, docno, label);
    topics(qid).  Output (label_set, qid, model, map, P_k.., ndcg_cut_k..).

    One plan for all label sets: the run is evaluated against every label set
    without re-ranking (the label set is a column).  Only relevant retrieved
    rows carry information for AP, P@k and DCG, so the run is inner-joined
    with the positive judgements; the cumulative count runs over those rows
    (at most k per topic and model).  The run is bounded by topics, models and k,
    the judgements grow with the corpus: each task hashes its part of the run, and
    the judgements are neither broadcast nor sorted."""
    pos = qrels.where(F.col("label") > 0).select("label_set", "qid", "docno", "label")
    j = ranked.select("qid", "model", "docno", "rank").hint("shuffle_hash").join(pos, ["qid", "docno"])
    w = (Window.partitionBy("label_set", "qid", "model").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = j.withColumn("_cum", F.count(F.lit(1)).over(w))
    disc = F.log2(F.col("rank") + 1.0)
    aggs = [F.sum(F.col("_cum") / F.col("rank")).alias("_ap_num")]
    for k in cutoffs:
        aggs.append(F.count_if(F.col("rank") <= k).alias(f"_rel_{k}"))
        aggs.append(F.sum(F.when(F.col("rank") <= k, F.col("label") / disc).otherwise(0.0)).alias(f"_dcg_{k}"))
    per_run = j.groupBy("label_set", "qid", "model").agg(*aggs)

    # per topic: number of relevant docs and ideal DCG@k, from the number of docs with each
    # label: one pass over the judgements, of each label no more than the largest cutoff is ranked
    kmax = max(cutoffs)
    per_label = pos.groupBy("label_set", "qid", "label").agg(F.count(F.lit(1)).alias("_n"))
    wq = Window.partitionBy("label_set", "qid")
    same = F.array_repeat("label", F.least("_n", F.lit(kmax)).cast("int"))
    top = per_label.withColumn("_R", F.sum("_n").over(wq)).select("label_set", "qid", "_R", F.explode(same).alias("label"))
    top = top.withColumn("_i", F.row_number().over(wq.orderBy(F.col("label").desc())))
    ideal = top.groupBy("label_set", "qid").agg(F.max("_R").alias("_R"), *[
        F.sum(F.when(F.col("_i") <= k, F.col("label") / F.log2(F.col("_i") + 1.0)).otherwise(0.0))
        .alias(f"_idcg_{k}") for k in cutoffs])

    # every (label_set, topic, model): label sets and models are literal lists
    grid = topics.select("qid").distinct() \
        .select("qid", F.explode(F.array(*[F.lit(s) for s in label_sets])).alias("label_set")) \
        .select("qid", "label_set", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    out = (grid.join(per_run, ["label_set", "qid", "model"], "left")
           .join(ideal, ["label_set", "qid"], "left"))
    cols = [F.coalesce(F.try_divide(F.col("_ap_num"), F.col("_R").cast("double")), F.lit(0.0)).alias("map")]
    for k in cutoffs:
        cols.append(F.coalesce(F.col(f"_rel_{k}") / float(k), F.lit(0.0)).alias(f"P_{k}"))
    for k in cutoffs:
        cols.append(F.coalesce(F.try_divide(F.col(f"_dcg_{k}"), F.col(f"_idcg_{k}")), F.lit(0.0))
                    .alias(f"ndcg_cut_{k}"))
    return out.select("label_set", "qid", "model", *cols)


def mean_per_model(metrics: DataFrame, cols: Sequence[str] = METRICS) -> DataFrame:
    return metrics.groupBy("label_set", "model").agg(*[F.avg(c).alias(c) for c in cols])
