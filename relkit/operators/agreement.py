"""Rater agreement: confusion matrices, Cohen's and Fleiss' kappa, label
frequencies, error rates, field-pair matrices and pooled kappa.

Shape of the work: one data-sized aggregation (counts per label pair, with
map-side partial aggregation); everything after it runs on K² rows per group
(K = number of distinct labels), so no step after the first shuffle grows with
the data.  No step joins on an empty key (no cartesian products); group-less
summaries are single aggregations over a union of tiny frames.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --------------------------------------------------------------------------
# label recoding
# --------------------------------------------------------------------------

def parse_label(c: Column | str) -> Column:
    """Label text → int, accepting float text ('1.0'); truncates like
    int(float(x)); unparsable text ('None', '') → null instead of raising."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string").try_cast("double").try_cast("int")


def binarize(c: Column | str) -> Column:
    """0 → 0, > 0 → 1, anything else → null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.lit(1)).when(c == 0, F.lit(0))


def remap_to_bin(c: Column | str) -> Column:
    """Only exactly 2 becomes 1; every other value is unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 2, F.lit(1)).otherwise(c)


def clamp_labels(c: Column | str, hi: int = 1) -> Column:
    """Values above ``hi`` become ``hi``; nulls stay null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > hi, F.lit(hi)).otherwise(c)


# --------------------------------------------------------------------------
# pairing (J7/J8)
# --------------------------------------------------------------------------

def pair_labels(a: DataFrame, b: DataFrame, keys: Sequence[str],
                a_label: str = "label", b_label: str = "label",
                a_name: str = "human", b_name: str = "pred") -> DataFrame:
    """Align two label sets on their key (not on row position)."""
    left = a.select(*keys, F.col(a_label).alias(a_name))
    right = b.select(*keys, F.col(b_label).alias(b_name))
    return left.join(right, list(keys), "inner")


# --------------------------------------------------------------------------
# confusion matrices
# --------------------------------------------------------------------------

def pair_counts(pairs: DataFrame, a: str = "human", b: str = "pred",
                by: Sequence[str] = ()) -> DataFrame:
    """(by..., a, b, n) over non-null pairs: the only data-sized step."""
    return (pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n")))


def _fill_grid(counts: DataFrame, a: str, b: str, by: Sequence[str], union: bool) -> DataFrame:
    """Zero-fill a count table over a label grid built per group from the
    K² count rows (union of both raters' labels, or observed a × observed b)."""
    if union:
        uni = F.array_sort(F.array_distinct(F.concat(F.collect_set(a), F.collect_set(b))))
        grid = counts.groupBy(*by).agg(uni.alias("_la"), uni.alias("_lb"))
    else:
        grid = counts.groupBy(*by).agg(F.array_sort(F.collect_set(a)).alias("_la"),
                                       F.array_sort(F.collect_set(b)).alias("_lb"))
    cells = (grid.select(*by, F.explode("_la").alias(a), "_lb")
             .select(*by, a, F.explode("_lb").alias(b)))
    return (cells.join(counts, [*by, a, b], "left")
            .select(*by, a, b, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def confusion_long(pairs: DataFrame, a: str = "human", b: str = "pred",
                   by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts over the union of both raters' labels (zero cells
    included): (by..., a, b, n)."""
    return _fill_grid(pair_counts(pairs, a, b, by), a, b, by, union=True)


def crosstab(pairs: DataFrame, a: str = "human", b: str = "pred",
             by: Sequence[str] = ()) -> DataFrame:
    """Cross tabulation over the *observed* values of each side (pd.crosstab)."""
    return _fill_grid(pair_counts(pairs, a, b, by), a, b, by, union=False)


def confusion_wide(conf: DataFrame, a: str = "human", b: str = "pred",
                   labels: Sequence[int] = (0, 1, 2), by: Sequence[str] = (),
                   observed_rows_only: bool = True) -> DataFrame:
    """Displayed matrix: one row per predicted label, one column ``<a>_<l>``
    per human label and ``<a>_other`` for labels not listed.  With ``observed_rows_only`` rows are restricted to the
    labels the predicting rater actually used (the ``cm[:2]`` cut)."""
    if observed_rows_only:
        row_tot = F.sum("n").over(Window.partitionBy(*by, b))
        conf = conf.withColumn("_rt", row_tot).where(F.col("_rt") > 0).drop("_rt")
    aggs = [F.sum(F.when(F.col(a) == lab, F.col("n")).otherwise(0)).cast("long").alias(f"{a}_{lab}")
            for lab in labels]
    other = F.sum(F.when(F.col(a).isin(list(labels)), 0).otherwise(F.col("n"))).cast("long").alias(f"{a}_other")
    return conf.groupBy(*by, b).agg(*aggs, other)


def row_max_flag(conf: DataFrame, row: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Flag the largest cell(s) of each displayed row (ties all flagged)."""
    w = Window.partitionBy(*by, row)
    return conf.withColumn("is_row_max", F.col("n") == F.max("n").over(w))


# --------------------------------------------------------------------------
# Cohen's kappa (A3)
# --------------------------------------------------------------------------

def kappa_from_confusion(conf: DataFrame, a: str = "human", b: str = "pred",
                         by: Sequence[str] = ()) -> DataFrame:
    """κ = (po − pe)/(1 − pe) from a zero-filled confusion table.  Marginals
    are windows over the K² rows; the diagonal row of label l carries both
    marginals of l, so one aggregation finishes the job.  pe = 1 (both raters
    used one and the same label) gives null."""
    ra = F.sum("n").over(Window.partitionBy(*by, a))
    rb = F.sum("n").over(Window.partitionBy(*by, b))
    c = conf.withColumn("_ra", ra).withColumn("_rb", rb)
    diag = F.col(a) == F.col(b)
    g = c.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.when(diag, F.col("n")).otherwise(0)).cast("double").alias("_agree"),
        F.sum(F.when(diag, F.col("_ra").cast("double") * F.col("_rb")).otherwise(0.0)).alias("_pe_num"),
    )
    n = F.col("n").cast("double")
    po = F.try_divide(F.col("_agree"), n)
    pe = F.try_divide(F.col("_pe_num"), n * n)
    return g.select(*by, "n", po.alias("po"), pe.alias("pe"),
                    F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa"))


def cohen_kappa(pairs: DataFrame, a: str = "human", b: str = "pred",
                by: Sequence[str] = ()) -> DataFrame:
    return kappa_from_confusion(confusion_long(pairs, a, b, by), a, b, by)


# --------------------------------------------------------------------------
# Fleiss' kappa
# --------------------------------------------------------------------------

def subject_category_counts(long: DataFrame, subject: Sequence[str], label: str = "label",
                            labels: Sequence[int] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """subjects × categories count table (aggregate_raters): n_<label> columns and
    ``n_other`` for labels not listed."""
    aggs = [F.count_if(F.col(label) == lab).alias(f"n_{lab}") for lab in labels]
    aggs.append(F.count_if(~F.col(label).isin(list(labels))).alias("n_other"))
    return long.where(F.col(label).isNotNull()).groupBy(*by, *subject).agg(*aggs)


def fleiss_kappa(long: DataFrame, subject: Sequence[str], label: str = "label",
                 by: Sequence[str] = ()) -> DataFrame:
    """Fleiss' κ with the raters of each subject as the rating set.
    P_i = (Σ_j n_ij² − k)/(k(k−1)), P̄ = mean P_i, Pe = Σ_j p_j².
    Output (by..., n_subjects, n_ratings, p_bar, p_e, kappa)."""
    cnt = (long.where(F.col(label).isNotNull())
           .groupBy(*by, *subject, label).agg(F.count(F.lit(1)).alias("nij")))
    per_subj = cnt.groupBy(*by, *subject).agg(
        F.sum("nij").alias("k"), F.sum(F.col("nij") * F.col("nij")).alias("s2"))
    p_i = F.try_divide((F.col("s2") - F.col("k")).cast("double"),
                       (F.col("k") * (F.col("k") - 1)).cast("double"))
    s_rows = per_subj.select(*by, F.lit("S").alias("_kind"), p_i.alias("_pi"),
                             F.col("k").cast("double").alias("_k"), F.lit(None).cast("double").alias("_sj"))
    per_label = cnt.groupBy(*by, label).agg(F.sum("nij").cast("double").alias("_sj"))
    l_rows = per_label.select(*by, F.lit("L").alias("_kind"), F.lit(None).cast("double").alias("_pi"),
                              F.lit(None).cast("double").alias("_k"), "_sj")
    u = s_rows.unionByName(l_rows)
    g = u.groupBy(*by).agg(
        F.count_if(F.col("_kind") == "S").alias("n_subjects"),
        F.sum("_k").cast("long").alias("n_ratings"),
        F.avg("_pi").alias("p_bar"),
        F.try_divide(F.sum(F.col("_sj") * F.col("_sj")), F.pow(F.sum("_sj"), 2)).alias("p_e"),
    )
    return g.select(*by, "n_subjects", "n_ratings", "p_bar", "p_e",
                    F.try_divide(F.col("p_bar") - F.col("p_e"), F.lit(1.0) - F.col("p_e")).alias("kappa"))


# --------------------------------------------------------------------------
# frequencies, error rates, positive counts
# --------------------------------------------------------------------------

def label_frequencies(df: DataFrame, label_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of each label per rater column: (by..., rater, label, n, share)."""
    entries = F.array(*[F.struct(F.lit(c).alias("rater"), F.col(c).cast("int").alias("label"))
                        for c in label_cols])
    long = df.select(*by, F.inline(entries))
    cnt = long.where(F.col("label").isNotNull()).groupBy(*by, "rater", "label").agg(
        F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*by, "rater"))
    return cnt.withColumn("share", F.col("n") / tot)


def judgement_counts(judgements: DataFrame, topic: str, item: str) -> DataFrame:
    """(n, n_topics, n_items) of a label set."""
    return judgements.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(topic).alias("n_topics"),
                          F.countDistinct(item).alias("n_items"))


def error_rates(pairs: DataFrame, a: str = "human", b: str = "pred",
                by: Sequence[str] = ()) -> DataFrame:
    """Disagreement share per predicted label (``by_pred``: cells of the row
    with the other human label / row total) and per human label (``by_human``).
    Output (by..., axis, label, n, n_diff, rate)."""
    counts = pair_counts(pairs, a, b, by)
    diff = (F.col(a) != F.col(b))
    by_pred = counts.groupBy(*by, F.col(b).alias("label")).agg(
        F.sum("n").alias("n"), F.sum(F.when(diff, F.col("n")).otherwise(0)).alias("n_diff")
    ).withColumn("axis", F.lit("by_pred"))
    by_human = counts.groupBy(*by, F.col(a).alias("label")).agg(
        F.sum("n").alias("n"), F.sum(F.when(diff, F.col("n")).otherwise(0)).alias("n_diff")
    ).withColumn("axis", F.lit("by_human"))
    out = by_pred.unionByName(by_human)
    return out.select(*by, "axis", "label", F.col("n").cast("long"), F.col("n_diff").cast("long"),
                      F.try_divide(F.col("n_diff").cast("double"), F.col("n").cast("double")).alias("rate"))


def positive_diff(pairs: DataFrame, a: str = "human", b: str = "pred", positive: int = 1,
                  by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_pred_pos, n_human_pos, diff) where diff = pred − human."""
    g = pairs.groupBy(*by).agg(F.count_if(F.col(b) == positive).alias("n_pred_pos"),
                               F.count_if(F.col(a) == positive).alias("n_human_pos"))
    return g.withColumn("diff", F.col("n_pred_pos") - F.col("n_human_pos"))


# --------------------------------------------------------------------------
# field-wise agreement
# --------------------------------------------------------------------------

def pivot_fields(long: DataFrame, ids: Sequence[str], fields: Sequence[str],
                 field: str = "field", label: str = "label") -> DataFrame:
    """Long (ids, field, label) → one row per ids with one column per field
    (first match; missing → null).  Single aggregation, known field list (no
    extra job to discover pivot values)."""
    aggs = [F.max(F.when(F.col(field) == f, F.col(label))).alias(f) for f in fields]
    return long.groupBy(*ids).agg(*aggs)


def unpivot_fields(wide: DataFrame, ids: Sequence[str], fields: Sequence[str],
                   field: str = "field", label: str = "label") -> DataFrame:
    return wide.unpivot(list(ids), list(fields), field, label)


def kappa_pair_matrix(long: DataFrame, subject: Sequence[str], fields: Sequence[str],
                      field: str = "field", label: str = "label") -> DataFrame:
    """Cohen's κ for every ordered pair of fields, one pass: pivot per subject
    (one shuffle on the subject key), emit the F² label pairs in-row, count,
    then κ on the K²·F² count rows.  Output (field_a, field_b, kappa, n)."""
    wide = pivot_fields(long, subject, fields, field, label)
    pairs = F.array(*[F.struct(F.lit(fa).alias("field_a"), F.lit(fb).alias("field_b"),
                               F.col(fa).alias("la"), F.col(fb).alias("lb"))
                      for fa, fb in product(fields, fields)])
    p = wide.select(F.inline(pairs))
    k = cohen_kappa(p, "la", "lb", by=["field_a", "field_b"])
    return k.select("field_a", "field_b", "n", "kappa")


def kappa_matrix_wide(kappa_long: DataFrame, fields: Sequence[str]) -> DataFrame:
    """5×5 matrix: row per field_a, one column per field_b."""
    aggs = [F.max(F.when(F.col("field_b") == f, F.col("kappa"))).alias(f) for f in fields]
    return kappa_long.groupBy("field_a").agg(*aggs)


def kappa_lower_mean(kappa_long: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Mean of the strict lower triangle (field_a after field_b in ``fields``)."""
    pos = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    lower = kappa_long.where(pos[F.col("field_a")] > pos[F.col("field_b")])
    return lower.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("kappa").alias("mean_kappa"))


def kappa_between_flag(kappa_long: DataFrame, lo: float = 0.25, hi: float = 0.40) -> DataFrame:
    return kappa_long.withColumn("in_band", F.col("kappa").between(lo, hi))


def pooled_kappa(a_long: DataFrame, b_long: DataFrame, subject: Sequence[str],
                 fields: Sequence[str], field: str = "field", label: str = "label") -> DataFrame:
    """One κ over the ratings of several fields stacked into a single pair
    list (pairs keyed by subject and field)."""
    a = a_long.where(F.col(field).isin(list(fields)))
    b = b_long.where(F.col(field).isin(list(fields)))
    p = pair_labels(a, b, [*subject, field], label, label, "a_label", "b_label")
    return cohen_kappa(p, "a_label", "b_label")
