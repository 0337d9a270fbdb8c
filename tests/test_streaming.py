from relkit.streaming.judgement_stream import start_judgement_ingest


def test_stream_ingest_is_incremental(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("1\t0\tt1\t2\n1 0 bad\n")
    q = start_judgement_ingest(spark, str(src), str(out), name=f"t{id(tmp_path)}")
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 1
    (src / "b.txt").write_text("2\t0\tt2\t1.0\n")
    q = start_judgement_ingest(spark, str(src), str(out), name=f"t{id(tmp_path)}")
    q.awaitTermination(120)
    got = {r.json_loc: r.relevancy for r in spark.read.parquet(str(out)).collect()}
    assert got == {"t1": 2, "t2": 1}
