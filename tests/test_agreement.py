"""Agreement operators against the golden confusion counts of BASELINE §2."""

import pytest
from pyspark.sql import functions as F

from relkit.operators import agreement as ag

# (variant, kind, expected kappa with the notebook's human coding,
#  expected kappa with the other coding, cells (human, llm): n)
GOLDEN = [
    ("A", "graded", 0.197820, 0.187130,
     {(0, 0): 30, (0, 1): 30, (0, 2): 5, (1, 0): 4, (1, 1): 11, (1, 2): 2, (2, 0): 1, (2, 1): 11, (2, 2): 6}),
    ("B", "binary", 0.315895, 0.145591, {(0, 0): 41, (0, 1): 24, (1, 0): 8, (1, 1): 9, (2, 0): 2, (2, 1): 16}),
    ("C", "graded", 0.250741, 0.255223,
     {(0, 0): 43, (0, 1): 14, (0, 2): 8, (1, 0): 8, (1, 1): 7, (1, 2): 2, (2, 0): 2, (2, 1): 9, (2, 2): 7}),
    ("D", "binary", 0.439462, 0.245433, {(0, 0): 54, (0, 1): 11, (1, 0): 9, (1, 1): 8, (2, 0): 5, (2, 1): 13}),
    ("A'", "graded", 0.106102, 0.129058, {(0, 0): 12, (0, 1): 50, (0, 2): 3, (1, 1): 17, (2, 1): 16, (2, 2): 2}),
    ("B'", "binary", 0.331942, 0.155284, {(0, 0): 45, (0, 1): 20, (1, 0): 9, (1, 1): 8, (2, 0): 3, (2, 1): 15}),
    ("C'", "graded", 0.353169, 0.322034,
     {(0, 0): 49, (0, 1): 14, (0, 2): 2, (1, 0): 8, (1, 1): 9, (2, 0): 3, (2, 1): 8, (2, 2): 7}),
    ("D'", "binary", 0.303944, 0.103420, {(0, 0): 54, (0, 1): 11, (1, 0): 14, (1, 1): 3, (2, 0): 5, (2, 1): 13}),
]


def _pairs(spark):
    rows = [(v, h, p) for v, _, _, _, cells in GOLDEN for (h, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "variant string, human int, pred int")


def test_golden_kappas_all_variants_one_pass(spark):
    pairs = _pairs(spark)
    raw = {r.variant: r.kappa for r in ag.cohen_kappa(pairs, by=["variant"]).collect()}
    binp = pairs.withColumn("human", ag.binarize("human"))
    binz = {r.variant: r.kappa for r in ag.cohen_kappa(binp, by=["variant"]).collect()}
    for v, kind, used, other, cells in GOLDEN:
        assert sum(cells.values()) == 100
        k_used, k_other = (raw[v], binz[v]) if kind == "graded" else (binz[v], raw[v])
        assert k_used == pytest.approx(used, abs=1e-6), v
        assert k_other == pytest.approx(other, abs=1e-6), v


def test_confusion_union_grid_and_total(spark):
    pairs = _pairs(spark).where(F.col("variant") == "B")
    conf = ag.confusion_long(pairs).collect()
    assert len(conf) == 9                      # union {0,1,2} x {0,1,2}
    assert sum(r.n for r in conf) == 100
    assert {(r.human, r.pred) for r in conf if r.n == 0} == {(0, 2), (1, 2), (2, 2)}
    obs = ag.crosstab(pairs).collect()
    assert len(obs) == 6                       # observed {0,1,2} x {0,1}


def test_kappa_properties(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (1, 1)], "human int, pred int")
    assert ag.cohen_kappa(df).first().kappa == pytest.approx(1.0)
    one = spark.createDataFrame([(1, 1)] * 5, "human int, pred int")
    assert ag.cohen_kappa(one).first().kappa is None          # pe = 1
    disjoint = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "human int, pred int")
    k = ag.cohen_kappa(disjoint).first().kappa
    assert k is not None and k <= 0
    a = _pairs(spark).where(F.col("variant") == "A")
    b = a.select(F.col("pred").alias("human"), F.col("human").alias("pred"))
    assert ag.cohen_kappa(a).first().kappa == pytest.approx(ag.cohen_kappa(b).first().kappa)


def test_fleiss_matches_hand_computation(spark):
    # 3 subjects x 3 raters
    rows = [(1, 0), (1, 0), (1, 0), (2, 0), (2, 1), (2, 1), (3, 1), (3, 1), (3, 1)]
    df = spark.createDataFrame(rows, "doc int, label int")
    r = ag.fleiss_kappa(df, ["doc"]).first()
    p_i = [1.0, (1 + 4 - 3) / 6, 1.0]
    p_bar = sum(p_i) / 3
    p_e = (4 / 9) ** 2 + (5 / 9) ** 2
    assert r.kappa == pytest.approx((p_bar - p_e) / (1 - p_e))
    assert r.n_subjects == 3


def test_error_rates_and_positive_diff(spark):
    pairs = _pairs(spark).where(F.col("variant") == "B").withColumn("human", ag.binarize("human"))
    rates = {(r.axis, r.label): r.rate for r in ag.error_rates(pairs).collect()}
    # human_bin/pred cells: (0,0)=41 (0,1)=24 (1,0)=10 (1,1)=25
    assert rates[("by_pred", 0)] == pytest.approx(10 / 51)
    assert rates[("by_pred", 1)] == pytest.approx(24 / 49)
    assert rates[("by_human", 0)] == pytest.approx(24 / 65)
    assert rates[("by_human", 1)] == pytest.approx(10 / 35)
    d = ag.positive_diff(pairs).first()
    assert (d.n_pred_pos, d.n_human_pos, d.diff) == (49, 35, 14)


def test_recoding(spark):
    df = spark.createDataFrame([("0",), ("1.0",), ("2",), ("None",), ("",), ("1.7",)], "raw string")
    out = df.select(ag.parse_label("raw").alias("l")).select(
        "l", ag.binarize("l").alias("b"), ag.remap_to_bin("l").alias("r"), ag.clamp_labels("l").alias("c"))
    got = [tuple(r) for r in out.collect()]
    assert got == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 1, 1, 1), (None, None, None, None),
                   (None, None, None, None), (1, 1, 1, 1)]


def test_pair_matrix_diagonal_and_lower_mean(spark):
    rows = [(d, f, (d // (i + 1)) % 2) for d in range(40) for i, f in enumerate(["a", "b", "c"])]
    long = spark.createDataFrame(rows, "doc int, field string, label int")
    km = ag.kappa_pair_matrix(long, ["doc"], ["a", "b", "c"])
    k = {(r.field_a, r.field_b): r.kappa for r in km.collect()}
    assert all(k[(f, f)] == pytest.approx(1.0) for f in "abc")
    assert k[("a", "b")] == pytest.approx(k[("b", "a")])
    mean = ag.kappa_lower_mean(km, ["a", "b", "c"]).first()
    assert mean.n_pairs == 3
