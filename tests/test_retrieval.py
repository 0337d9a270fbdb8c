"""Ranking, metrics and system-comparison cases computed by hand."""

import math

import pytest

from relkit.functions.text import add_term_frequencies, tokenize
from relkit.operators import evaluate as ev
from relkit.operators import rankers as rk
from relkit.operators import systems as sy
from relkit.operators import fieldindex as fi
from relkit.operators.textindex import TextIndex, stop_terms, store


def test_term_frequencies_in_row(spark):
    df = spark.createDataFrame([(1, "The cat, the HAT! the wörld 42"), (2, "")], "id int, text string")
    out = add_term_frequencies(df.select("id", tokenize("text").alias("t")), "t", "tfs")
    got = {r.id: {x.term: x.tf for x in r.tfs} for r in out.collect()}
    assert got[1] == {"the": 3, "cat": 1, "hat": 1, "wörld": 1, "42": 1}
    assert got[2] == {}


def test_index_statistics(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y z"), ("c", "")], "docno string, text string")
    idx = TextIndex.build(docs)
    ts = {r.term: (r.df, r.cf) for r in idx.term_stats().collect()}
    assert ts == {"x": (1, 2), "y": (2, 2), "z": (1, 1)}
    cs = idx.coll_stats().first()
    assert (cs.n_docs, cs.n_tokens) == (3, 5)


def test_rank_ties_break_on_docno_desc(spark):
    scored = spark.createDataFrame([(1, "d1", 1.0), (1, "d3", 1.0), (1, "d2", 2.0)],
                                   "qid int, docno string, s_tf double")
    r = rk.rank(scored, ["Tf"], k=2).orderBy("rank").collect()
    assert [x.docno for x in r] == ["d2", "d3"]


def test_bm25_all_models_one_pass(spark, tmp_path):
    docs = spark.createDataFrame([("a", "apple banana apple"), ("b", "banana cherry"), ("c", "cherry")],
                                 "docno string, text string")
    topics = spark.createDataFrame([(1, "apple cherry")], "qid int, query string")
    out = rk.retrieve(store(TextIndex.build(docs), str(tmp_path), stop_percent=100), topics, rk.MODEL_NAMES, k=10)
    bm = {r.docno: r.score for r in out.where("model = 'BM25'").collect()}
    n, avgdl = 3.0, 6 / 3

    def w(tf, dl, df):
        return math.log2((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 9 / 9
    assert bm["a"] == pytest.approx(round(w(2, 3, 1), 6), abs=1e-6)
    assert bm["c"] == pytest.approx(round(w(1, 1, 2), 6), abs=1e-6)
    assert set(out.select("model").distinct().toPandas().model) == set(rk.MODEL_NAMES)


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "M", f"d{i}", i) for i in range(1, 6)],
                                   "qid int, model string, docno string, rank int")
    qrels = spark.createDataFrame([("h", 1, "d2", 1), ("h", 1, "d4", 1), ("h", 1, "d9", 1), ("h", 2, "d1", 0)],
                                  "label_set string, qid int, docno string, label int")
    topics = spark.createDataFrame([(1,), (2,)], "qid int")
    m = {r.qid: r for r in ev.evaluate(ranked, qrels, topics, ["M"], ["h"]).collect()}
    assert m[1].map == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert m[1].P_5 == pytest.approx(0.4) and m[1].P_10 == pytest.approx(0.2)
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    idcg = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert m[1].ndcg_cut_5 == pytest.approx(dcg / idcg)
    assert (m[2].map, m[2].P_5, m[2].ndcg_cut_10) == (0.0, 0.0, 0.0)   # no relevant doc


def test_kendall_tau(spark):
    vals = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0), ("d", 4.0, 4.0)],
                                 "model string, x double, y double")
    t = sy.kendall_tau(vals, "x", "y").first()
    assert t.n_pairs == 6 and t.tau == pytest.approx(4 / 6)
    same = sy.kendall_tau(vals, "x", "x").first()
    assert same.tau == pytest.approx(1.0)


def test_golden_scores(spark, tmp_path):
    """One score a model, from its published definition and by hand: "x" stands
    twice in a document of 4 words; 3 documents of 12 words, 2 with "x", 3 in all."""
    docs = spark.createDataFrame([("a", "x x y z"), ("b", "x u u"), ("c", "v w w w w")], "docno string, text string")
    topics = spark.createDataFrame([(1, "x")], "qid int, query string")
    out = rk.retrieve(store(TextIndex.build(docs), str(tmp_path), stop_percent=100), topics)
    got = {r.model: r.score for r in out.where("docno = 'a'").collect()}
    lg, e = math.log2, math.e
    tf, dl, df, cf, n, tokens = 2, 4, 2, 3, 3, 12   # average length 4: normalisation leaves tf as it is
    core = tf * lg(tf / dl * 4 * n / cf) + 0.5 * lg(2 * math.pi * tf * (1 - tf / dl))
    rel, prior, smooth, expect = tf / dl, cf / tokens, (tf + 1) / (dl + 1), cf * dl / tokens
    want = {
        "TF_IDF": 1.2 * tf / (tf + 1.2) * lg(n / df + 1), "BM25": lg(1.5 / 2.5) * 2.2 * tf / (tf + 1.2),
        "DirichletLM": lg((tf + 2500 * prior) / (dl + 2500) / prior),
        "PL2": (tf * lg(tf / 1.0) + (1 - tf) * lg(e) + 0.5 * lg(2 * math.pi * tf)) / (tf + 1),
        "CoordinateMatch": 1, "DFIC": lg(1 + (tf - expect) ** 2 / expect), "DFIZ": lg(1 + (tf - expect) / expect ** 0.5),
        "DFRee": tf * lg(smooth / rel) * ((tf + 1) * lg(smooth / prior) - tf * lg(rel / prior) + 0.5 * lg(smooth / rel)),
        "Dl": 4, "DLH": (core + (dl - tf) * lg(1 - rel)) / 2.5, "DLH13": core / 2.5,
        "DPH": (1 - rel) ** 2 / (tf + 1) * core, "Hiemstra_LM": lg(1 + 0.15 * rel / (0.85 * prior)),
        "IFB2": (cf + 1) / (df * (tf + 1)) * tf * lg((n + 1) / (cf + 0.5)),
        "In_expB2": (cf + 1) / (df * (tf + 1)) * tf * lg((n + 1) / (n * (1 - e ** -1) + 0.5)),
        "In_expC2": (cf + 1) / (df * (tf * math.log(2) + 1)) * tf * math.log(2) * lg((n + 1) / (n * (1 - e ** -1) + 0.5)),
        "InB2": (cf + 1) / (df * (tf + 1)) * tf * lg((n + 1) / (df + 0.5)), "InL2": tf / (tf + 1) * lg((n + 1) / (df + 0.5)),
        "LemurTF_IDF": 1.2 * tf / (tf + 1.2) * lg(n / df) ** 2, "LGD": lg((df / n + tf) / (df / n)), "Tf": 2,
    }
    assert set(want) == set(rk.MODEL_NAMES)
    assert got == pytest.approx(want, abs=1e-9)


def test_stop_list_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "the x the"), ("b", "the y"), ("c", "the"), ("d", "")],
                                 "docno string, text string")
    idx = TextIndex.build(docs)
    n = idx.doc_lengths.count()
    from pyspark.sql import functions as F
    assert [r.term for r in stop_terms(idx.term_stats(), F.lit(n), 50).collect()] == ["the"]
    kept = store(idx, str(tmp_path), stop_percent=50)
    assert sorted((r.term, r.docno, r.tf, r.dl) for r in kept.postings.collect()) == [("x", "a", 1, 1), ("y", "b", 1, 1)]
    assert {r.docno: r.dl for r in kept.doc_lengths.collect()} == {"a": 1, "b": 1, "c": 0, "d": 0}
    assert kept.collection.first() == (4, 2)
    topics = spark.createDataFrame([(1, "the x")], "qid int, query string")
    ranked = rk.retrieve(kept, topics, ["BM25"])
    assert [r.docno for r in ranked.collect()] == ["a"]
    assert "dynamicpruning" in ranked._jdf.queryExecution().executedPlan().toString()


def test_all_models_rank_by_terms_of_many_documents(spark, tmp_path):
    """No term is left out where all models rank: "the" stands in every document, and
    one of them shares no other term with the topic."""
    from relkit.plans import q_retrieval as qr
    docs = [(i, text) for i, text in enumerate(["the", "the apple the", "the pear", "the plum plum"])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "The apple")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = qr.rank_all_models(spark, str(tmp_path)).collect()
    assert len(rows) == len(rk.MODEL_NAMES) * len(docs)
    score = {r.docno: r.score for r in rows if r.model == "BM25"}

    def w(tf, dl, df):
        return math.log2((4 - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / 2.25))
    want = {"0": w(1, 1, 4), "1": w(2, 3, 4) + w(1, 3, 1), "2": w(1, 2, 4), "3": w(1, 3, 4)}
    assert score == pytest.approx(want, abs=1e-6)
    assert {r.docno: r.score for r in rows if r.model == "CoordinateMatch"} == {"0": 1, "1": 2, "2": 1, "3": 1}


def test_fields_are_weighed(spark):
    docs = spark.createDataFrame([("a", "apple", "pear pear"), ("b", "pear", "apple"), ("c", None, "plum")],
                                 "docno string, title string, body string")
    idx = fi.FieldIndex.build(docs, ["title", "body"])
    got = {(r.term, r.docno): dict(r.tfs) for r in idx.postings.collect()}
    assert got == {("apple", "a"): {"title": 1}, ("pear", "a"): {"body": 2}, ("pear", "b"): {"title": 1},
                   ("apple", "b"): {"body": 1}, ("plum", "c"): {"body": 1}}
    assert {r.field: r.n_tokens for r in idx.field_lengths().collect()} == {"title": 2, "body": 4}
    terms = spark.createDataFrame([(1, "apple", 1.0)], "qid int, term string, qtf double")
    first = {w: fi.rank_fields(fi.score_fields(idx, terms, {"title": w, "body": 1.0})).where("rank = 1").first()
             for w in (5.0, 0.0)}
    assert (first[5.0].docno, first[0.0].docno) == ("a", "b")
    wtf = 5.0 / (1 - 0.75 + 0.75 * 1 / (2 / 3))
    assert first[5.0].score == pytest.approx(math.log(1 + (3 - 2 + 0.5) / 2.5) * wtf / (1.2 + wtf))


def test_t_test_and_sensitivity(spark):
    cases = [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (float("inf"), 4, 0.0), (1.0, 1, 0.5), (-3.0, 2, 0.09546597),
             (2.5, 3, 0.08770665), (1.96, 10000, 0.05002352), (None, 3, None), (2.0, 0, None)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, dof int")
    got = [r.p for r in df.select(sy.t_two_sided_p("t", "dof").alias("p")).collect()]
    for p, (_, _, want) in zip(got, cases):
        assert (p is None and want is None) or p == pytest.approx(want, abs=1e-7)
    rows = []
    for q in range(5):
        rows += [(q, "a", 0.5), (q, "b", 0.5), (q, "c", 0.5 + 0.1)]   # a=b: all 0; c: constant shift
    long = spark.createDataFrame(rows, "qid int, model string, value double")
    st = {(r.model_a, r.model_b): r for r in sy.paired_ttest_stats(long, []).collect()}
    assert st[("a", "b")].t is None
    assert st[("a", "c")].t == float("-inf")
    s = sy.sensitivity(long, []).first()
    assert (s.n_pairs, s.n_significant) == (3, 2) and s.sensitivity == pytest.approx(0.67)


def test_long_and_short_documents_have_the_same_postings(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "x y x", "y z"), ("b", "", None), ("c", "z", "Z, z x")],
                                 "docno string, title string, body string")

    def built():
        return sorted((r.docno, r.term, sorted(r.tfs.items()), sorted(r.lens.items()))
                      for r in fi.FieldIndex.build(docs, ["title", "body"]).postings.collect())

    short = built()
    monkeypatch.setattr(fi, "SHORT", 0)
    assert short == built()
    assert short[0] == ("a", "x", [("title", 2)], [("body", 2), ("title", 3)])


def _exchanges(df):
    """The keys by which a frame's rows are dealt."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]


def test_pairs_of_topic_and_document_are_not_shuffled(spark, tmp_path):
    """They are summed where the postings of their document were dealt."""
    from relkit.plans import fixtures as fx
    docs = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "z")], "docno string, text string")
    topics = spark.createDataFrame([(1, "x y"), (2, "z")], "qid int, query string")
    index = store(TextIndex.build(docs), str(tmp_path), stop_percent=100)
    scored = rk.score(index, rk.indexed_terms(index, rk.query_terms(topics)), ["BM25"])
    fields = fi.FieldIndex.build(docs, ["text"])
    by_field = fi.score_fields(fields, rk.query_terms(topics), {"text": 1.0})
    overlap = fx.spark_pair_overlap(spark, "/root/testdata/sf0.001")
    for df in (scored, by_field, overlap):
        assert _exchanges(df) and not any("qid" in keys and "doc" in keys for keys in _exchanges(df))


def test_floors_leave_the_best(spark, tmp_path):
    """With a bound from one in several documents the ranking is that without it, ties too."""
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(["x"] * (i % 7 + 1) + ["y"] * (i % 5))) for i in range(300)],
                                 "docno string, text string")
    topics = spark.createDataFrame([(1, "x"), (2, "y x"), (3, "none")], "qid int, query string")
    index = store(TextIndex.build(docs), str(tmp_path), stop_percent=100)
    models, k = ["BM25", "Tf", "Dl", "DPH"], 4
    plain = rk.rank(rk.score(index, rk.indexed_terms(index, rk.query_terms(topics)), models), models, k)
    bound = rk.retrieve(index, topics, models, k)
    assert "floors" in bound._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(bound.collect()) == sorted(plain.collect())
    assert bound.count() == 2 * len(models) * k


def test_each_model_is_computed_inside_its_sum(spark, tmp_path):
    """No projection holds the formulas of all models: as one method they are too long to be compiled."""
    docs = spark.createDataFrame([("a", "x y"), ("b", "y z")], "docno string, text string")
    topics = spark.createDataFrame([(1, "x y")], "qid int, query string")
    index = store(TextIndex.build(docs), str(tmp_path), stop_percent=100)
    scores = rk.score(index, rk.indexed_terms(index, rk.query_terms(topics)))
    plan = scores._jdf.queryExecution().optimizedPlan().toString().splitlines()
    holders = [line.strip(" :+-").split(" ")[0] for line in plan if "LOG2" in line.upper()]
    assert holders == ["Aggregate"]


def test_scores_in_units_are_rounded_as_by_round(spark):
    from pyspark.sql import functions as F
    values = [0.0, -0.0, 2.5e-10, -2.5e-10, 1.49e-10, -1.51e-10, 12.345678901250, -7.1234567890049, 2e5, 7e8, -7e8, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    old = F.round(F.col("v") * rk.UNITS).cast("bigint")
    assert [a == b for a, b in df.select(old, rk.units(F.col("v"))).collect()] == [True] * len(values)


def test_judgements_are_not_broadcast(spark):
    """They grow with the corpus; the run is bounded and is what each task hashes.  The number of
    relevant documents and the ideal list come from one aggregation of them."""
    ranked = spark.createDataFrame([(1, "M", f"d{i}", i) for i in range(1, 6)],
                                   "qid int, model string, docno string, rank int")
    rows = [("h", 1, f"d{i}", 1 + (i % 7 == 0)) for i in range(2, 40, 2)] + [("h", 1, "d3", 0)]
    qrels = spark.createDataFrame(rows, "label_set string, qid int, docno string, label int")
    out = ev.evaluate(ranked, qrels, spark.createDataFrame([(1,)], "qid int"), ["M"], ["h"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [qid" in plan
    got = out.first()
    assert got.map == pytest.approx((1 / 2 + 2 / 4) / 19)
    gains = [2, 2] + [1] * 17                          # d14 and d28 have label 2
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(gains[:10]))
    assert got.ndcg_cut_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
