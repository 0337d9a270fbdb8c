"""Cell-matrix edge rows (FIXTURES §1)."""

from pyspark.sql import functions as F

from relkit.functions import relation as rel


def _run(spark, rows, *exprs):
    df = spark.createDataFrame(rows, "id int, relation array<array<string>>, idx int")
    df = rel.clean_relation(df, "relation", "clean")
    return [r.asDict() for r in df.select("id", "clean", *exprs).orderBy("id").collect()]


def test_clean_edge_rows(spark):
    rows = [(1, [], 0), (2, [["", ""]], 0), (3, [[None, ""]], 0), (4, [["", "a"], ["", "b", "c"]], 0)]
    out = {r["id"]: r["clean"] for r in _run(spark, rows)}
    assert out == {1: [], 2: [], 3: [[None]], 4: [["a"], ["b", "c"]]}


def test_header_and_key_indexes(spark):
    rows = [(1, [["h1", "a"], ["h2", "b"]], -1), (2, [["h1", "a"], ["h2", "b"]], 0),
            (3, [["h1", "a"], ["h2", "b"]], 9), (4, [["h1", "a"], ["h2", "b"]], 1)]
    out = _run(spark, rows, rel.header_text("clean", "idx").alias("h"),
               rel.key_column_text("clean", "idx").alias("k"), rel.transpose("clean").alias("t"),
               rel.table_content("clean").alias("c"))
    by = {r["id"]: r for r in out}
    assert by[1]["h"] == "" and by[1]["k"] == ""
    assert by[2]["h"] == "h1 h2" and by[2]["k"] == "h1 a"
    assert by[3]["h"] is None and by[3]["k"] == "h2 b"        # past the end: null / column 1
    assert by[4]["h"] == "a b" and by[4]["k"] == "h2 b"
    assert by[2]["t"] == [["h1", "h2"], ["a", "b"]]
    assert by[2]["c"] == "h1 a h2 b"


def test_catchall_skips_nulls_and_strip_nul(spark):
    df = spark.createDataFrame([("x\u0000y", None)], "a string, b string")
    r = df.select(rel.strip_nul("a").alias("s"), rel.catchall(F.lit("c"), "a", "b", F.lit("p"), F.lit("t"))
                  .alias("all")).first()
    assert r.s == "xy"
    assert r["all"] == "c x\u0000y p t"


def test_clean_with_and_without_empty_cells(spark):
    """A full list as long as the first keeps every position; a shorter one does not."""
    rows = [(1, [["", "a"], ["x", "y"]], 0), (2, [["", "a", ""], ["x", "y"]], 0), (3, [["a"], ["", "b"]], 0),
            (4, [["", None], ["", None]], 0)]
    out = {r["id"]: r["clean"] for r in _run(spark, rows)}
    assert out == {1: [["", "a"], ["x", "y"]], 2: [["", "a"], ["x", "y"]], 3: [["a"], ["", "b"]], 4: [[None], [None]]}


def test_nul_leaves_cells(spark):
    df = spark.createDataFrame([([["a\x00b", None], ["\x00"]],), ([["a"], None],), (None,)], "r array<array<string>>")
    assert [r[0] for r in df.select(rel.strip_nul_cells("r")).collect()] == [[["ab", None], [""]], [["a"], None], None]
