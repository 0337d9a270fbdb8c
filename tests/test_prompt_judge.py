"""Prompt rendering, budget cut, shrink ladder, reply parsing and judging."""

import json

from pyspark.sql import functions as F

from relkit.functions import prompt as pr
from relkit.functions import prompt_variants as pv
from relkit.operators import judge as jg


def test_render_is_literal(spark):
    df = spark.createDataFrame([(r"\d $1 $TOPIC", "q $TABLE")], "cell string, query string")
    rel = F.array(F.array(F.col("cell")))
    out = df.select(pr.render_table_prompt(F.col("query"), pr.table_json(rel)).alias("p"),
                    pr.table_json(rel).alias("native")).first()
    expected_json = json.dumps([[r"\d $1 $TOPIC"]]).encode("unicode-escape").decode()
    assert out.native == expected_json
    # $TOPIC first, then $TABLE: the query's "$TABLE" is filled with the table too
    assert out.p.startswith("Topic: 'q " + expected_json)


def test_table_json_escapes_like_json(spark):
    rows = [["caf\u00e9", "\x00\x01\x1f\x7f", "\b\f\n\r\t"], ["\U0001F600 x", 'q"\\', None], ["", "\u4e2d\uffff"]]
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    assert df.select(pr.table_json("r")).first()[0] == json.dumps(rows).encode("unicode-escape").decode()


def test_budget_cut_and_shrink(spark):
    df = spark.createDataFrame([("one two,  three four five",)], "p string")
    r = df.select(pr.token_count("p").alias("n"),
                  pr.budget_cut("p", limit=5, margin=2).alias("cut"),
                  pr.budget_cut("p", limit=50).alias("nocut"),
                  pr.shrink("p", 1, step=5).alias("s1"), pr.shrink("p", 0, step=5).alias("s0"),
                  pr.shrink("p", 9, step=5).alias("s9")).first()
    assert r.n == 6 and r.cut == "one two," and r.nocut == "one two,  three four five"
    assert r.s0 == "one two,  three four five" and r.s1 == "one two,  three four" and r.s9 == ""


def test_parse_rating_edges(spark):
    df = spark.createDataFrame([("Relevant (1)",), ("Relevant (1) ",), ("relevant (1)",), ("",), (None,),
                                ("Highly Relevant (2)",)], "r string")
    got = [tuple(x) for x in df.select(pr.parse_rating("r", True), pr.parse_rating("r", False)).collect()]
    assert got == [(1, 1), (None, None), (None, None), (None, None), (None, None), (2, None)]


def test_judge_and_retry(spark):
    def overlap(prompts, systems, attempts):
        """Counts distinct topic words in the rest of the prompt: relevant from two."""
        import re
        out = []
        for p in prompts:
            topic, _, body = p.partition("\n")
            shared = set(re.findall(r"\w+", topic.lower()[7:])) & set(re.findall(r"\w+", body.lower()))
            out.append("Relevant (1)" if len(shared) >= 2 else "Irrelevant (0)")
        return out

    def flaky(prompts, systems, attempts):
        if min(attempts) < 2:
            raise ConnectionError("judge unavailable")
        return overlap(prompts, systems, attempts)

    df = spark.createDataFrame([(1, "Topic: 'red apple'\nTable: red apple"), (2, "Topic: 'red apple'\nTable: x"),
                                (3, "abc")], "k int, prompt string")
    out = {r.k: r for r in jg.judge(df, overlap, ["k"], graded=False).collect()}
    assert out[1].label == 1 and out[2].label == 0 and out[3].label == 0
    retry = {r.k: r for r in jg.judge_with_retry(df, flaky, ["k"], step=1).collect()}
    assert {(r.attempts, r.annotator) for r in retry.values()} == {(3, "llm")}
    assert (retry[1].label, retry[2].label) == (0, 0)  # the third attempt has lost "le"

    def broken(prompts, systems, attempts):
        raise ConnectionError("down")

    err = jg.judge_with_retry(df, broken, ["k"]).collect()
    assert len(err) == 3 and all(r.label == 0 and r.attempts == 7 and r.annotator == "error" for r in err)
    kept = jg.judge(df, broken, ["k"]).first()
    assert kept.label is None and kept.error.startswith("ConnectionError")
    assert jg.judge(df, broken, ["k"], on_error="drop").count() == 0


def test_attempts_are_resolved(spark):
    rows = [("a", 0, None), ("a", 1, "Relevant (1)"), ("a", 2, "Irrelevant (0)"),      # the first that parses
            ("b", 0, "maybe"), ("b", 1, ""), *[("c", i, "?") for i in range(7)], ("c", 7, "Relevant (1)"),
            ("d", 0, "Relevant (1)"), ("d", 0, "Irrelevant (0)"), (None, 0, "Relevant (1)")]
    got = {r.k: tuple(r)[1:] for r in jg.resolve_attempts(
        spark.createDataFrame(rows, "k string, attempt int, reply string"), ["k"]).collect()}
    assert got == {"a": (1, 2, "llm"), "b": (None, 2, None), "c": (0, 7, "error"), "d": (0, 1, "llm"),
                   None: (1, 1, "llm")}
    prompts = spark.createDataFrame([(k, "x" * 500) for k in "abcde"], "k string, prompt string")
    attempts = spark.createDataFrame(rows, "k string, attempt int, reply string")
    left = {r.k: (r.attempt, len(r.prompt)) for r in jg.open_attempts(prompts, attempts, ["k"]).collect()}
    assert left == {"b": (2, 100), "e": (0, 500)}


def test_cut_comes_before_shrink(spark):
    df = spark.createDataFrame([("a b c d e f", "x y", True), ("a b c d e f", "x y", False), ("a b", None, True)],
                               "p string, s string, counted boolean")
    got = [r[0] for r in df.select(pv.attempt_prompt(F.col("p"), F.col("s"), F.col("counted"), 0, 7, 1)).collect()]
    assert got == ["a b c d", "a b c d e f", "a b"]
    assert set(pv.VARIANTS) >= {"A_split_graded", "fields_binary"} and len(pv.VARIANTS) == 10


def test_table_json_of_plain_cells(spark):
    tables = [[["a b", "1-2"], []], [], [["", "~"]], [["x", None]], [["a'#[]"], ["\\"]]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, r array<array<string>>")
    got = [r[0] for r in df.orderBy("i").select(pr.table_json("r")).collect()]
    assert got == [json.dumps(t).encode("unicode-escape").decode() for t in tables]


def test_fixed_system_messages_are_counted_with_the_plan(spark):
    rows = spark.range(1).select(F.inline(pv.variant_array()))
    got = rows.select("variant", "on_topic", "system_tokens", pr.token_count("system").alias("n")).collect()
    assert len(got) == len(pv.VARIANTS) and all(r.system_tokens == r.n for r in got)
