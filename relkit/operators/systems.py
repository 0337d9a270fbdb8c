"""System comparison (A12-A14, J11, J12): Kendall's tau-b between the model
orderings of two label sets, paired t-tests between every pair of models, their
p-values and the sensitivity (share of pairs with p < alpha).

The models of a group (a metric, a topic ...) are gathered in one array, bounded
by the fixed model list, and paired inside the row; no table is joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_pairs(items: Column | str, make) -> Column:
    """``make(a, b)`` for every two items of an array, a before b, as one array."""
    items = F.col(items) if isinstance(items, str) else items
    return F.flatten(F.transform(items, lambda a, i: F.transform(
        F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda b: make(a, b))))


def kendall_tau(values: DataFrame, x: str, y: str, by: Sequence[str] = (),
                item: str = "model", digits: int = 9) -> DataFrame:
    """tau-b = (C − D) / sqrt(pairs untied in x · pairs untied in y) per group.
    Values are rounded to ``digits`` first so that ties do not depend on
    floating-point summation order."""
    v = F.struct(F.col(item).alias("item"), F.round(F.col(x), digits).alias("x"), F.round(F.col(y), digits).alias("y"))
    rows = values.groupBy(*by).agg(F.array_sort(F.collect_list(v)).alias("v"))

    def compare(a: Column, b: Column) -> Column:
        dx, dy = F.signum(a["x"] - b["x"]), F.signum(a["y"] - b["y"])
        return F.struct((dx * dy).alias("s"), F.abs(dx).alias("x"), F.abs(dy).alias("y"))

    rows = rows.select(*by, row_pairs("v", compare).alias("p"))

    def total(field: str) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda n, p: n + F.coalesce(p[field], F.lit(0.0)))

    tau = F.try_divide(total("s"), F.sqrt(total("x") * total("y")))
    return rows.select(*by, F.size("p").cast("long").alias("n_pairs"), tau.alias("tau"))


def paired_differences(long: DataFrame, by: Sequence[str], unit: str = "qid",
                       item: str = "model", value: str = "value") -> DataFrame:
    """(by..., unit, model_a, model_b, d) for every pair of items measured on
    the same unit."""
    v = F.struct(F.col(item).alias("item"), F.col(value).alias("value"))
    rows = long.groupBy(*by, unit).agg(F.array_sort(F.collect_list(v)).alias("v"))
    pair = row_pairs("v", lambda a, b: F.struct(a["item"].alias("model_a"), b["item"].alias("model_b"),
                                                (a["value"] - b["value"]).alias("d")))
    return rows.select(*by, unit, F.inline(pair))


def paired_ttest_stats(long: DataFrame, by: Sequence[str], unit: str = "qid",
                       item: str = "model", value: str = "value") -> DataFrame:
    """(by..., model_a, model_b, n, mean_d, sd_d, t) -- t = mean/(sd/√n);
    sd = 0 gives ±inf for a non-zero mean and null (not significant) for 0."""
    d = paired_differences(long, by, unit, item, value)
    g = d.groupBy(*by, "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"))
    se = F.col("sd_d") / F.sqrt(F.col("n").cast("double"))
    t = (F.when(F.col("sd_d") > 0, F.col("mean_d") / se)
         .when(F.col("mean_d") > 0, F.lit(float("inf")))
         .when(F.col("mean_d") < 0, F.lit(float("-inf"))))
    return g.withColumn("t", t)


def t_two_sided_p(t: Column | str, dof: Column | str) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom.

    With tan(angle) = |t| / sqrt(dof) the share within ±t is a finite series in
    cos²(angle), of dof / 2 terms: for even dof sin * (1 + 1/2 c² + 1·3/(2·4) c⁴
    + ...), for odd dof 2/π * (angle + sin * (c + 2/3 c³ + 2·4/(3·5) c⁵ + ...)).
    An infinite t has p = 0; p is null where t is, or below one degree."""
    t, dof = (F.col(c) if isinstance(c, str) else c for c in (t, dof))
    n = dof.cast("int")
    angle = F.atan2(F.abs(t), F.sqrt(n.cast("double")))
    cos, sin, even = F.cos(angle), F.sin(angle), n % 2 == 0
    steps = F.when(even, n.cast("double") / 2 - 1).otherwise((n - 3) / 2).cast("int")

    def add(state: Column, k: Column) -> Column:
        ratio = F.when(even, (2 * k - 1) / (2.0 * k)).otherwise(2 * k / (2.0 * k + 1))
        term = state["term"] * ratio * cos * cos
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    first = F.when(even, F.lit(1.0)).otherwise(cos)
    series = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
                         F.struct(first.alias("term"), first.alias("total")), add)["total"]
    within = (F.when(n == 1, 2 / F.pi() * angle).when(even, sin * series)
              .otherwise(2 / F.pi() * (angle + sin * series)))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - within))
    return F.when(t.isNotNull() & ~F.isnan(t) & (n >= 1), F.when(F.abs(t) == float("inf"), 0.0).otherwise(p))


def ttest_pvalues(long: DataFrame, by: Sequence[str], unit: str = "qid", item: str = "model",
                  value: str = "value") -> DataFrame:
    """``paired_ttest_stats`` with the two-sided p-value of each pair."""
    stats = paired_ttest_stats(long, by, unit, item, value)
    return stats.withColumn("p", t_two_sided_p("t", F.col("n") - 1))


def sensitivity(long: DataFrame, by: Sequence[str], unit: str = "qid", item: str = "model",
                value: str = "value", alpha: float = 0.05) -> DataFrame:
    """Share of item pairs whose paired two-sided t-test has p < alpha,
    rounded half-even to 2 digits: (by..., n_pairs, n_significant, sensitivity)."""
    sig = F.coalesce(F.col("p") < alpha, F.lit(False))
    g = ttest_pvalues(long, by, unit, item, value).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(sig).alias("n_significant"))
    return g.withColumn("sensitivity", F.bround(F.col("n_significant") / F.col("n_pairs"), 2))
