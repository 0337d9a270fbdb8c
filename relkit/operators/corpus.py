"""Corpus statistics (A16-A19, W8, F11) and exact sampling.

No global sort or un-partitioned window over data-sized input: the k-th
smallest length is found from the count per distinct length (bounded by the
largest length, not by the number of documents), histogram bounds come from
one scalar aggregate, and the sample is a top-n by a keyed hash (each task
keeps n rows, then one merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the cost estimate.
PRICE_PER_1K_TOKENS = 0.003
JUDGED_PAIRS = 6949


def cost_mean(lengths: DataFrame, col: str = "n_tokens", price: float = PRICE_PER_1K_TOKENS,
              n_pairs: int = JUDGED_PAIRS) -> DataFrame:
    """Mean tokens × price/1000 × number of pairs."""
    return lengths.agg(F.avg(col).alias("mean_tokens")).withColumn(
        "cost", F.col("mean_tokens") * (price / 1000) * n_pairs)


def kth_smallest(lengths: DataFrame, k: Column | int, col: str = "n_tokens") -> DataFrame:
    """Exact k-th smallest value (0-based, as ``sorted(x)[k]``).

    Counts per distinct value first (map-side partial aggregation), then a
    running sum over the distinct values only."""
    counts = lengths.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("_cum", F.sum("_n").over(w))
    kk = F.lit(k) if isinstance(k, int) else k
    return cum.where(F.col("_cum") > kk).agg(F.min(col).alias("value"))


def cost_kth(lengths: DataFrame, col: str = "n_tokens", price: float = PRICE_PER_1K_TOKENS,
             n_pairs: int = JUDGED_PAIRS) -> DataFrame:
    """sorted[round(n/2) + 1] × price/1000 × pairs (the reference's index,
    one past the upper middle; round is half-even) and the true median
    sorted[n // 2] alongside."""
    n = lengths.agg(F.count(F.lit(1))).scalar()
    k_ref = (F.bround(n / 2.0, 0) + 1).cast("long")
    kth = kth_smallest(lengths, k_ref, col).scalar()
    med = kth_smallest(lengths, F.floor(n / 2).cast("long"), col).scalar()
    one = lengths.sparkSession.range(1)
    return one.select(kth.alias("kth_tokens"), med.alias("median_tokens"),
                      (kth * (price / 1000) * n_pairs).alias("cost"))


def log_histogram(lengths: DataFrame, col: str = "n_tokens", bins: int = 20) -> DataFrame:
    """Equal-width bins on log10 between the smallest and the largest
    positive value: (bin, lo, hi, n) with every bin present."""
    pos = lengths.where(F.col(col) > 0).select(F.log10(F.col(col)).alias("_l"))
    bounds = pos.agg(F.struct(F.min("_l").alias("lo"), F.max("_l").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / bins
    b = F.least(F.floor(F.try_divide(F.col("_l") - lo, width)), F.lit(bins - 1))
    counts = pos.select(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    grid = lengths.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", F.pow(F.lit(10.0), lo + F.col("bin") * width).alias("lo"),
                    F.pow(F.lit(10.0), lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def sample_exact(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly n rows without replacement, reproducible for a seed: order
    by md5(key ‖ seed) (a hash both engines compute identically), ties by key.
    Planned as TakeOrderedAndProject (per-task top-n, then one merge)."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")
