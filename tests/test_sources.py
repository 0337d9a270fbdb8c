"""Readers: qrels/topics/run text and web-table JSON Lines edge rows."""

import gzip
import json

import pytest

from relkit.sources import trec
from relkit.sources import webtables as wt


def _lines(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, pos long")


def test_qrels_edge_rows(spark):
    lines = _lines(spark, ["1 0 t1 2", "1 0 t2", "1 0 t3 1 x", "2 0 t4 1.0", "2 0 t5 None",
                           "3  0   t6 1", "3\t0 t7\t0"])
    got = {r.json_loc: r.relevancy for r in trec.parse_qrels(lines).collect()}
    assert got == {"t1": 2, "t4": 1, "t5": None, "t6": 1, "t7": 0}


def test_topics_edge_rows(spark):
    lines = _lines(spark, ["1 first query", "2 a  b   c", "1 last query", "3"])
    got = {r.qid: r.query for r in trec.parse_topics(lines, order="pos").collect()}
    assert got == {"1": "last query", "2": "a  b   c"}
    assert [r.value for r in trec.bad_topic_lines(lines).collect()] == ["3"]


def test_unicode_and_tab_whitespace(spark):
    lines = _lines(spark, ["\t2 lead tab", "3\t", "4 q\t", "5\u00a0nbsp query", "   "])
    got = {r.qid: r.query for r in trec.parse_topics(lines, order="pos").collect()}
    assert got == {"2": "lead tab", "4": "q", "5": "nbsp query"}
    assert [r.value for r in trec.bad_topic_lines(lines).collect()] == ["3\t", "   "]
    q = trec.parse_qrels(_lines(spark, ["1\u00a00\u00a0t1 2", "\t1 0 t2 1\t"])).collect()
    assert {(r.json_loc, r.relevancy) for r in q} == {("t1", 2), ("t2", 1)}


def test_label_files_of_equal_name(spark, tmp_path):
    for d, label in (("human", 0), ("llm a+b", 1)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "qrels.txt").write_text(f"1\t0\tt1\t{label}\n")
    got = trec.read_label_files(spark, {d: str(tmp_path / d / "qrels.txt") for d in ("human", "llm a+b")})
    assert {r.variant: r.relevancy for r in got.collect()} == {"human": 0, "llm a+b": 1}


def test_run_six_fields(spark):
    lines = _lines(spark, ["1 Q0 d1 1 2.5 run", "1 Q0 d2 2 run"])
    r = trec.parse_run(lines).collect()
    assert len(r) == 1 and r[0].score == 2.5 and r[0].rank == 1


def _record(loc, **over):
    rec = {"json_loc": loc, "title": "t", "relation": [["a", ""], ["", ""]], "tableType": "R",
           "hasKeyColumn": True, "keyColumnIndex": 0, "hasHeader": False, "headerPosition": "NONE",
           "headerRowIndex": -1, "tableOrientation": "HORIZONTAL", "tableNum": 1, "recordEndOffset": 9,
           "recordOffset": 1, "textBeforeTable": "b\u0000x", "textAfterTable": "a", "entities": "{}",
           "pageTitle": "p", "url": "u"}
    rec.update(over)
    return json.dumps(rec)


def test_jsonl_reader_edge_rows(spark, tmp_path):
    f1 = tmp_path / "one.jsonl"
    f2 = tmp_path / "two.jsonl"
    missing = json.loads(_record("m"))
    del missing["url"]
    f1.write_text("\n".join(["header line", _record("a"), "", "{bad", json.dumps(missing)]) + "\n")
    f2.write_text("\n".join(["skip me", _record("b")]) + "\n")
    recs, bad = wt.read_web_tables(spark, [str(f1), str(f2)], skip_first_line=True)
    got = {r.json_loc: r for r in recs.collect()}
    assert set(got) == {"a", "m", "b"}
    assert got["m"].missing_keys == ["url"] and got["a"].missing_keys == []
    assert [r.line for r in bad.collect()] == ["{bad"]
    recs2, bad2 = wt.read_web_tables(spark, [str(f2)], skip_first_line=False)
    assert recs2.count() == 1 and bad2.count() == 1              # "skip me" is quarantined
    clean = wt.clean_records(recs.where("json_loc = 'a'")).first()
    assert clean.relation == [["a"]] and clean.textBeforeTable == "bx"
    seven = wt.normalise(wt.clean_records(recs))
    assert set(seven) == {"web_table", "table_meta", "text_before", "text_after", "table_entities",
                          "page_title", "page_url"}


def test_qrels_writer_roundtrip(spark, tmp_path):
    j = spark.createDataFrame([(1, "t1", 2), (2, "t2", 0)], "topic int, json_loc string, relevancy int")
    out = str(tmp_path / "q")
    trec.write_qrels(j, out)
    back = {r.json_loc: r.relevancy for r in trec.read_qrels(spark, out).collect()}
    assert back == {"t1": 2, "t2": 0}


def test_broken_gzip_is_read_as_far_as_it_goes(spark, tmp_path):
    lines = [json.dumps({"json_loc": f"t{i}", "length": i, "rated": i % 2 == 0, "pad": str(hash(i * 7919) % 10 ** 9)})
             for i in range(20000)]
    packed = gzip.compress("\n".join([*lines, ""]).encode())
    (tmp_path / "whole.gz").write_bytes(packed)
    (tmp_path / "cut.gz").write_bytes(packed[:len(packed) // 2])
    (tmp_path / "two.gz").write_bytes(gzip.compress(b'{"json_loc": "a"}\n{bad\n\n') + gzip.compress(b'{"json_loc": "b"}'))
    (tmp_path / "none.gz").write_bytes(b"")
    (tmp_path / "noise.gz").write_bytes(b"no gzip at all")
    rows, losses = wt.read_corpus_stats_counted(spark, str(tmp_path))
    of = {r.file.rsplit("/", 1)[1]: r for r in losses.collect()}
    assert (of["whole.gz"].n_lines, of["whole.gz"].n_rows, of["whole.gz"].broken) == (20000, 20000, False)
    cut = of["cut.gz"]
    assert cut.broken and 5000 < cut.n_rows < 15000 and cut.n_lost <= 1
    assert (of["two.gz"].n_rows, of["two.gz"].n_lost, of["two.gz"].broken) == (2, 2, False)
    assert "none.gz" not in of  # Spark's source has no row for an empty file
    assert (of["noise.gz"].n_lines, of["noise.gz"].broken) == (0, True)
    assert rows.count() == 20000 + cut.n_rows + 2
    assert rows.where("json_loc = 't4000'").count() == 2


def test_relations_round_trip(spark, tmp_path):
    recs, _ = wt.parse_web_tables(spark.createDataFrame([(_record("a"),), (_record("b", url=None),), (_record("a"),)],
                                                        "value string"))
    wt.write_relations(wt.clean_records(recs), str(tmp_path))
    for name, schema in wt.RELATIONS.items():
        rows = wt.read_relation(spark, str(tmp_path), name)
        assert rows.columns == schema.names and sorted(r.json_loc for r in rows.collect()) == ["a", "b"]
    urls = {r.json_loc: r.url for r in wt.read_relation(spark, str(tmp_path), "page_url").collect()}
    assert urls == {"a": "u", "b": None}


def test_key_faults(spark):
    def keys(*names):
        return spark.createDataFrame([(n,) for n in names], "json_loc string")
    got = wt.key_faults({"web_table": keys("a", "b", None, None), "page_url": keys("a", "a", "z")}).collect()
    assert {tuple(r) for r in got} == {("web_table", "null_key", None, 2), ("page_url", "duplicate_key", "a", 2),
                                       ("page_url", "orphan", "z", 1)}


def test_longest_path_names_a_file(spark, tmp_path):
    for d, label in (("x", 0), ("x/inner", 1), ("y1", 2)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "q.txt").write_text(f"1 0 {d} {label}\n")
    fields = {"outer": f"{tmp_path}/x/q.txt", "inner": f"{tmp_path}/x/inner", "glob": f"{tmp_path}/y?"}
    got = {r.json_loc: r.field for r in trec.read_field_files(spark, fields).collect()}
    assert got == {"x": "outer", "x/inner": "inner", "y1": "glob"}


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(5000)))
    (tmp_path / "a.txt").write_text("".join(f"a{i} {'x' * (i % 50)}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = trec.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        whole = [r.value.split(" ")[0] for r in sorted(rows.collect(), key=lambda r: r.line_no)]
        assert whole == [f"a{i}" for i in range(5000)] + [f"b{i}" for i in range(5000)]
        each = trec.numbered_lines(spark, str(tmp_path), per_file=True).collect()
        assert {(r.value.split(" ")[0][0], r.line_no, int(r.value.split(" ")[0][1:]) + 1) for r in each} == {
            (f, i, i) for f in "ab" for i in range(1, 5001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_of_no_path_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "q[1].txt").write_text("1 0 t 1\n")
    with pytest.raises(Exception, match="none of the paths"):
        trec.read_field_files(spark, {"f": f"{tmp_path}/q\\[1\\].txt"}).collect()


def test_records_of_a_join_are_made_once(spark):
    """The joins read stored records of the judged tables; a line is made once."""
    from relkit.plans import q_tables as qt
    sf = "/root/testdata/sf0.001"
    for q in (qt.rated_tables_inner, qt.rated_tables_by_topic, qt.tables_for_qrels_right, qt.normalised_seven):
        assert "lineitem" not in " ".join(q(spark, sf).inputFiles())
    plan = qt._records(spark, sf).select("json_loc", "relation")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan  # below which no filter on the line is pushed
