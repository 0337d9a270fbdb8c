"""Views that give the driver tables the shape of the reference's inputs.

Each view exists twice: as a Spark DataFrame builder (``spark_*``) and as a
DuckDB CTE (``SQL_CTES``) used by the oracle.  The two are written
independently from the same rule (see FIXTURES.md §3).

Scale notes
* query-side tables (topics, query terms) come from ``benchmark``; the planner
  and AQE choose the join from their sizes;
* document terms are produced in-row; the documents are dealt by doc_id before,
  so the pair overlap is a probe and an aggregation per (qid, doc) without a
  shuffle of pairs where the topics' terms are broadcast (the planner's choice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.functions.text import TOKEN_SPLIT, tokenize
from relkit.session import table

# Fixed values of the fixture rules.
# The topic is the whole benchmark passage; shares are per cent of its distinct tokens.
MIN_SHARE = 30            # pair kept
GRADE1_SHARE = 40         # human grade 1
GRADE2_SHARE = 60         # human grade 2
LLM_MIN_CHARS = 1000      # LLM-like rule: n_chars >= 1000 and the share below
LLM_SHARE = 35
LLM_HIGH_SHARE = 50       # grade 2 of the graded LLM-like rule


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def spark_topics(spark: SparkSession, sf: str) -> DataFrame:
    """v_topics(qid BIGINT, query STRING)."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.array_join(tokenize("text"), " ").alias("query"),
    )


def spark_docs(spark: SparkSession, sf: str) -> DataFrame:
    """v_docs(docno STRING, text STRING)."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("docno"), "text")


def spark_query_terms(topics: DataFrame) -> DataFrame:
    """(qid, n_terms, term) distinct query terms."""
    terms = topics.select("qid", F.array_distinct(tokenize("query")).alias("_terms"))
    return terms.select("qid", F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term"))


def _share(percent: int):
    return F.col("shared") * 100 >= F.col("n_terms") * percent


def spark_pair_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id, n_chars, shared, n_terms) for pairs sharing MIN_SHARE of the topic's terms."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    # explode_outer + filter: avoids the inferred size() > 0 filter that would
    # tokenize every document a second time below the projection
    # dealt by document first: pairs are counted where their document lies, and only
    # those that share enough leave the task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_terms = docs.repartition(parts, "doc_id").select("doc_id", "n_chars",
                            F.explode_outer(F.array_distinct(tokenize("text"))).alias("term")) \
        .where(F.col("term").isNotNull())
    qterms = spark_query_terms(spark_topics(spark, sf))
    return (doc_terms.join(qterms, "term")
            .groupBy("qid", "doc_id", "n_chars", "n_terms")
            .agg(F.count(F.lit(1)).alias("shared"))
            .where(_share(MIN_SHARE)))


def spark_qrels_a(spark: SparkSession, sf: str) -> DataFrame:
    """v_qrels_a(qid, docno, label): human-like graded labels."""
    p = spark_pair_overlap(spark, sf)
    return p.select(
        "qid", F.col("doc_id").cast("string").alias("docno"),
        F.when(_share(GRADE2_SHARE), 2).when(_share(GRADE1_SHARE), 1).otherwise(0).alias("label"))


def spark_qrels_b(spark: SparkSession, sf: str) -> DataFrame:
    """v_qrels_b(qid, docno, label): LLM-like binary labels."""
    p = spark_pair_overlap(spark, sf)
    return p.select(
        "qid", F.col("doc_id").cast("string").alias("docno"),
        F.when((F.col("n_chars") >= LLM_MIN_CHARS) & _share(LLM_SHARE), 1)
         .otherwise(0).alias("label"))


def _llm_labels():
    def entry(variant, graded, label):
        return F.struct(F.lit(variant).alias("variant"), F.lit(graded).alias("graded"), label.alias("label"))

    long = F.col("n_chars") >= LLM_MIN_CHARS
    return F.array(
        entry("bin_len", False, F.when(long & _share(LLM_SHARE), 1).otherwise(0)),
        entry("bin_overlap", False, F.when(_share(LLM_SHARE), 1).otherwise(0)),
        entry("graded", True, F.when(_share(LLM_HIGH_SHARE), 2).when(_share(LLM_SHARE), 1).otherwise(0)))


def spark_qrels_both(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, docno, human, variant, graded, label): human grade and every LLM
    label of a pair from one overlap pass."""
    human = F.when(_share(GRADE2_SHARE), 2).when(_share(GRADE1_SHARE), 1).otherwise(0).alias("human")
    return spark_pair_overlap(spark, sf).select(
        "qid", F.col("doc_id").cast("string").alias("docno"), human, F.inline(_llm_labels()))


# Rater fields for the multi-field agreement fixture.  Fixed rule table:
# field -> (human rule, llm rule) over labels ⋈ documents.
def _rater_rules():
    c = F.col
    return {
        "quality": (c("quality"), (c("n_chars") >= 1500).cast("int")),
        "toxic": (c("toxic"), c("text").contains("!").cast("int")),
        "long": ((c("n_chars") >= 1000).cast("int"), (c("n_chars") >= 800).cast("int")),
        "english": ((c("lang") == "en").cast("int"), c("lang").isin("en", "de").cast("int")),
        "romance": (c("lang").isin("fr", "es").cast("int"), (c("lang") == "fr").cast("int")),
    }


RATER_FIELDS = ["quality", "toxic", "long", "english", "romance"]


def spark_rater_long(spark: SparkSession, sf: str) -> DataFrame:
    """v_rater_long(doc_id, field, rater, label): labels unpivoted to five
    judged fields for two raters ('human', 'llm')."""
    lab = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text"), "doc_id")
    rules = _rater_rules()
    entries = []
    for f in RATER_FIELDS:
        h, m = rules[f]
        entries.append(F.struct(F.lit(f).alias("field"), F.lit("human").alias("rater"), h.alias("label")))
        entries.append(F.struct(F.lit(f).alias("field"), F.lit("llm").alias("rater"), m.alias("label")))
    return lab.select("doc_id", F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# Web-table fixture (v_relation, v_web_raw, projections)
# --------------------------------------------------------------------------

def spark_relation(spark: SparkSession, sf: str) -> DataFrame:
    """v_relation(l_orderkey, relation ARRAY<ARRAY<STRING>>): four columns of
    cells per order (outer = columns), lines ordered by
    (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
    l_returnflag, l_linestatus); cells blanked by rule to create empties."""
    li = table(spark, sf, "lineitem")
    lines = F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_returnflag", "l_linestatus")))
    g = li.groupBy("l_orderkey").agg(lines.alias("lines"))

    def blank_all(x):
        return (x["l_returnflag"] == "N") & (x["l_linestatus"] == "O")

    c0 = F.transform("lines", lambda x: F.when(x["l_returnflag"] == "N", F.lit("")).otherwise(x["l_returnflag"]))
    c1 = F.transform("lines", lambda x: F.when(blank_all(x), F.lit("")).otherwise(x["l_partkey"].cast("string")))
    c2 = F.transform("lines", lambda x: F.when(blank_all(x), F.lit(""))
                     .otherwise(x["l_quantity"].cast("bigint").cast("string")))
    c3 = F.transform("lines", lambda x: F.when(x["l_linestatus"] == "O", F.lit("")).otherwise(x["l_linestatus"]))
    return g.select("l_orderkey", F.array(c0, c1, c2, c3).alias("relation"))


def spark_page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", "url",
        F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("page_title"))


def spark_web_raw(spark: SparkSession, sf: str) -> DataFrame:
    """v_web_raw: one web-table record per order with lineitems (flat columns
    named as the JSONL keys)."""
    rel = spark_relation(spark, sf)
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    pages = spark_page_titles(spark, sf)
    n_pages = pages.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    # the narrow rows first: the cells, dealt by order when they were gathered, move once
    o = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    o = o.withColumn("_page", F.col("o_orderkey") % n_pages)
    o = o.join(pages, o["_page"] == pages["page_id"], "left")
    o = o.join(rel, o["o_orderkey"] == rel["l_orderkey"])
    idx = (F.col("o_orderkey") % 4 - 1).cast("int")
    return o.select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("json_loc"),
        F.col("o_orderpriority").alias("title"),
        F.col("relation"),
        F.col("o_orderstatus").alias("tableType"),
        (idx >= 0).alias("hasKeyColumn"),
        idx.alias("keyColumnIndex"),
        (idx >= 0).alias("hasHeader"),
        F.when(idx >= 0, F.lit("FIRST_ROW")).otherwise(F.lit("NONE")).alias("headerPosition"),
        idx.alias("headerRowIndex"),
        F.lit("HORIZONTAL").alias("tableOrientation"),
        (F.col("o_orderkey") % 10).cast("int").alias("tableNum"),
        # the SQL's INTEGER ends at key 21,474,836
        (F.col("o_orderkey") * 100 + 99).cast("bigint").alias("recordEndOffset"),
        (F.col("o_orderkey") * 100).cast("bigint").alias("recordOffset"),
        F.col("c_name").alias("textBeforeTable"),
        F.col("c_mktsegment").alias("textAfterTable"),
        F.to_json(F.struct(F.col("o_custkey").alias("cust"),
                           F.col("o_orderpriority").alias("priority"))).alias("entities"),
        F.col("page_title").alias("pageTitle"),
        F.col("url"),
    )


def spark_table_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements on web tables: (topic, iteration, json_loc, relevancy) for
    every 5th order (including orders without lineitems → missing tables)."""
    return _table_topics(spark, sf, table(spark, sf, "orders").where(F.col("o_orderkey") % 5 == 0))


def spark_table_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every order: the tables that prompts are rendered for."""
    return _table_topics(spark, sf, table(spark, sf, "orders"))


def _table_topics(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    n_topics = table(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    return orders.select(
        (F.col("o_custkey") % n_topics).alias("topic"),
        F.lit(0).alias("iteration"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("json_loc"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2)
         .when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0).alias("relevancy"))


# --------------------------------------------------------------------------
# DuckDB side (oracle CTEs).  Names match the Spark builders.
# --------------------------------------------------------------------------

def _tok(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), '{TOKEN_SPLIT}'), "
            f"lambda t: t <> '')")


SQL_CTES: dict[str, str] = {
    "v_topics": f"""
        SELECT item_id AS qid,
               array_to_string({_tok('text')}, ' ') AS query
        FROM benchmark""",
    "v_docs": "SELECT CAST(doc_id AS VARCHAR) AS docno, text FROM documents",
    "v_query_terms": f"""
        SELECT DISTINCT qid, unnest({_tok('query')}) AS term FROM v_topics""",
    "v_doc_terms": f"""
        SELECT DISTINCT doc_id, n_chars, unnest({_tok('text')}) AS term FROM documents""",
    "v_pair_overlap": f"""
        SELECT x.*, n.n_terms, 100 * x.shared AS pct
        FROM (SELECT q.qid, d.doc_id, d.n_chars, count(*) AS shared
              FROM v_doc_terms d JOIN v_query_terms q ON d.term = q.term
              GROUP BY q.qid, d.doc_id, d.n_chars) x
        JOIN (SELECT qid, count(*) AS n_terms FROM v_query_terms GROUP BY qid) n ON n.qid = x.qid
        WHERE 100 * x.shared >= {MIN_SHARE} * n.n_terms""",
    "v_qrels_a": f"""
        SELECT qid, CAST(doc_id AS VARCHAR) AS docno,
               CASE WHEN pct >= {GRADE2_SHARE} * n_terms THEN 2
                    WHEN pct >= {GRADE1_SHARE} * n_terms THEN 1 ELSE 0 END AS label
        FROM v_pair_overlap""",
    "v_qrels_b": f"""
        SELECT qid, CAST(doc_id AS VARCHAR) AS docno,
               CASE WHEN n_chars >= {LLM_MIN_CHARS} AND pct >= {LLM_SHARE} * n_terms THEN 1 ELSE 0 END AS label
        FROM v_pair_overlap""",
    "v_qrels_llm": f"""
        SELECT 'bin_len' AS variant, false AS graded, qid, CAST(doc_id AS VARCHAR) AS docno,
               CASE WHEN n_chars >= {LLM_MIN_CHARS} AND pct >= {LLM_SHARE} * n_terms THEN 1 ELSE 0 END AS label
        FROM v_pair_overlap
        UNION ALL
        SELECT 'bin_overlap', false, qid, CAST(doc_id AS VARCHAR),
               CASE WHEN pct >= {LLM_SHARE} * n_terms THEN 1 ELSE 0 END FROM v_pair_overlap
        UNION ALL
        SELECT 'graded', true, qid, CAST(doc_id AS VARCHAR),
               CASE WHEN pct >= {LLM_HIGH_SHARE} * n_terms THEN 2 WHEN pct >= {LLM_SHARE} * n_terms THEN 1 ELSE 0 END
        FROM v_pair_overlap""",
    "v_rater_base": """
        SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.text
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_rater_long": """
        SELECT doc_id, 'quality' AS field, 'human' AS rater, quality AS label FROM v_rater_base
        UNION ALL SELECT doc_id, 'quality', 'llm', CAST(n_chars >= 1500 AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'toxic', 'human', toxic FROM v_rater_base
        UNION ALL SELECT doc_id, 'toxic', 'llm', CAST(contains(text, '!') AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'long', 'human', CAST(n_chars >= 1000 AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'long', 'llm', CAST(n_chars >= 800 AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'english', 'human', CAST(lang = 'en' AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'english', 'llm', CAST(lang IN ('en', 'de') AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'romance', 'human', CAST(lang IN ('fr', 'es') AS INTEGER) FROM v_rater_base
        UNION ALL SELECT doc_id, 'romance', 'llm', CAST(lang = 'fr' AS INTEGER) FROM v_rater_base""",
    "v_relation": """
        SELECT l_orderkey, [
            list(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus),
            list(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '' ELSE CAST(l_partkey AS VARCHAR) END
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus),
            list(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN ''
                      ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus),
            list(CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus)
        ] AS relation
        FROM lineitem GROUP BY l_orderkey""",
    "v_page_titles": r"""
        SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS page_title FROM pages""",
    "v_web_raw": """
        SELECT 't' || CAST(o.o_orderkey AS VARCHAR) AS json_loc,
               o.o_orderpriority AS title,
               r.relation,
               o.o_orderstatus AS tableType,
               (o.o_orderkey % 4 - 1) >= 0 AS hasKeyColumn,
               CAST(o.o_orderkey % 4 - 1 AS INTEGER) AS keyColumnIndex,
               (o.o_orderkey % 4 - 1) >= 0 AS hasHeader,
               CASE WHEN (o.o_orderkey % 4 - 1) >= 0 THEN 'FIRST_ROW' ELSE 'NONE' END AS headerPosition,
               CAST(o.o_orderkey % 4 - 1 AS INTEGER) AS headerRowIndex,
               'HORIZONTAL' AS tableOrientation,
               CAST(o.o_orderkey % 10 AS INTEGER) AS tableNum,
               CAST(o.o_orderkey * 100 + 99 AS INTEGER) AS recordEndOffset,
               CAST(o.o_orderkey * 100 AS INTEGER) AS recordOffset,
               c.c_name AS textBeforeTable,
               c.c_mktsegment AS textAfterTable,
               CAST(to_json({'cust': o.o_custkey, 'priority': o.o_orderpriority}) AS VARCHAR) AS entities,
               p.page_title AS pageTitle,
               p.url AS url
        FROM orders o
        JOIN v_relation r ON r.l_orderkey = o.o_orderkey
        LEFT JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN v_page_titles p ON p.page_id = o.o_orderkey % (SELECT count(*) FROM pages)""",
    "v_table_qrels": """
        SELECT o_custkey % (SELECT count(*) FROM benchmark) AS topic, 0 AS iteration,
               't' || CAST(o_orderkey AS VARCHAR) AS json_loc,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END
                 AS relevancy
        FROM orders WHERE o_orderkey % 5 = 0""",
    "v_table_topics": """
        SELECT o_custkey % (SELECT count(*) FROM benchmark) AS topic, 't' || CAST(o_orderkey AS VARCHAR) AS json_loc,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END
                 AS relevancy
        FROM orders""",
}

# dependency order of the CTEs
_DEPS = {
    "v_topics": [], "v_docs": [], "v_query_terms": ["v_topics"], "v_doc_terms": [],
    "v_pair_overlap": ["v_doc_terms", "v_query_terms"],
    "v_qrels_a": ["v_pair_overlap"], "v_qrels_b": ["v_pair_overlap"],
    "v_qrels_llm": ["v_pair_overlap"],
    "v_rater_base": [], "v_rater_long": ["v_rater_base"],
    "v_relation": [], "v_page_titles": [],
    "v_web_raw": ["v_relation", "v_page_titles"],
    "v_table_qrels": [], "v_table_topics": [],
}


def sql_with(views: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Build ``WITH <needed fixture CTEs>, <extra CTEs> <body>``."""
    order: list[str] = []

    def visit(v):
        for d in _DEPS.get(v, []):
            visit(d)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    parts = [f"{v} AS MATERIALIZED ({SQL_CTES[v]})" for v in order]
    parts += [f"{k} AS MATERIALIZED ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
