"""Judgement ⋈ table joins.

All stored relations are keyed by json_loc, so the chained joins below share
one hash partitioning on json_loc: every input is shuffled once and the whole
chain runs as co-partitioned sort-merge (or, when AQE sees a small side,
broadcast) joins without re-shuffling between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATED_COLUMNS = ["query", "page_title", "title", "relation", "table_type", "has_header", "text_before",
                 "text_after", "entities", "relevancy", "json_loc", "topic"]


def rated_tables(judgements: DataFrame, topics: DataFrame, t: dict[str, DataFrame],
                 topic: int | None = None, annotator: str = "HUMAN") -> DataFrame:
    """J1 (+P3): inner join judgements ⋈ topics ⋈ six table relations.
    ``topic`` filters one topic (a bound value, pushed below the joins)."""
    j = judgements
    if topic is not None and topic != -1:
        j = j.where(F.col("topic") == F.lit(topic))
    q = topics.select(F.col("qid").alias("topic"), "query")
    out = (j.join(q, "topic")
           .join(t["web_table"].select("json_loc", "title", "relation", "table_type"), "json_loc")
           .join(t["page_title"], "json_loc")
           .join(t["table_meta"].select("json_loc", "has_header"), "json_loc")
           .join(t["text_before"], "json_loc")
           .join(t["text_after"], "json_loc")
           .join(t["table_entities"], "json_loc"))
    return out.select(*RATED_COLUMNS, F.lit(annotator).alias("annotator"))


def table_attributes(t: dict[str, DataFrame]) -> DataFrame:
    """The seven relations inner-joined on json_loc (15 attributes)."""
    return (t["web_table"].select("json_loc", "title", "relation", "table_type")
            .join(t["page_title"], "json_loc")
            .join(t["table_meta"].select("json_loc", "has_header", "header_pos", "header_row_index",
                                         "table_orientation", "has_key_column", "key_column_index"),
                  "json_loc")
            .join(t["text_before"], "json_loc")
            .join(t["text_after"], "json_loc")
            .join(t["table_entities"], "json_loc")
            .join(t["page_url"], "json_loc"))


def tables_for_qrels(judgements: DataFrame, topics: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """J2 + J3: table attributes RIGHT-joined to the judged keys; every
    judgement row is kept (``missing`` = its table is absent from one of the
    relations, where the reference raises), with its topic text attached."""
    attrs = table_attributes(t).withColumn("_found", F.lit(True))
    q = topics.select(F.col("qid").alias("topic"), "query")
    out = attrs.join(judgements, "json_loc", "right").join(q, "topic", "left")
    return out.withColumn("missing", F.col("_found").isNull()).drop("_found")


def missing_tables(judgements: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Judged keys without a complete table record."""
    return judgements.join(table_attributes(t).select("json_loc"), "json_loc", "left_anti")


def count_check(judgements: DataFrame, found: DataFrame) -> DataFrame:
    """(n_judged, n_found, complete): whether every judged row has its
    table; ``complete`` instead of an exception, so a job can branch on it."""
    one = (judgements.select(F.lit(1).alias("_j"), F.lit(0).alias("_f"))
           .unionByName(found.select(F.lit(0).alias("_j"), F.lit(1).alias("_f"))))
    n = one.agg(F.coalesce(F.sum("_j"), F.lit(0)).alias("n_judged"), F.coalesce(F.sum("_f"), F.lit(0)).alias("n_found"))
    return n.withColumn("complete", F.col("n_judged") == F.col("n_found"))


def rated_flag(items: DataFrame, judged_keys: DataFrame, key: str) -> DataFrame:
    """Existence flag via a left join on the distinct judged keys."""
    k = judged_keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return items.join(k, key, "left").withColumn("rated", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
