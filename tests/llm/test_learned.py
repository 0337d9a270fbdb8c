"""Held-out accuracy of the learned operators and the pipeline as a whole."""

from __future__ import annotations

import corpus_pipeline
from relkit.llm import lang_cnn, queries
from relkit.session import table as read

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    got = queries.op1_language_id(spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out AND lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_quality_of_held_out_rows(spark):
    got = queries.op10_quality(spark, SF).join(read(spark, SF, "labels").select("doc_id", "quality"), "doc_id")
    rows = got.where("held_out AND quality IS NOT NULL").collect()
    assert len(rows) > 50 and sum(r.quality == r.predicted for r in rows) / len(rows) > 0.9


def test_toxicity_of_held_out_rows(spark):
    got = queries.op8_toxicity(spark, SF).join(read(spark, SF, "labels").select("doc_id", "toxic"), "doc_id")
    rows = got.where("held_out AND toxic IS NOT NULL").collect()
    assert len(rows) > 30 and sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.9


def test_predictions_read_text_alone(spark):
    docs = read(spark, SF, "documents").limit(200)
    net = lang_cnn.fit(docs)
    a = docs.select("doc_id", lang_cnn.identify(docs, docs.text, net).alias("p")).collect()
    b = docs.drop("lang", "source").select("doc_id", lang_cnn.identify(docs, docs.text, net).alias("p")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_pipeline_packs_what_its_stages_keep(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    last = max(r.sequence_id for r in rows)
    filled: dict[int, int] = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 for s, n in filled.items() if s != last)


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
