"""Web-table ingest queries: JSONL parsing, cell cleaning, derived text
columns, the seven normalised relations and the judgement joins
(S1, S11, F1-F6, R6, P1, P3, J1-J3, J5, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from relkit.functions import relation as rel
from relkit.operators import joins as jn
from relkit.plans import fixtures as fx
from relkit.plans.registry import register
from relkit.session import stored, table
from relkit.sources import webtables as wt

# In the two queries on missing tables text_after loses 5 % of its rows.
DROP_RULE_MOD, DROP_RULE_REM = 20, 3


# ---------------------------------------------------------------- Spark fixtures

def _web_lines(spark, sf):
    """v_web_raw as JSON Lines text (what a dump file holds)."""
    raw = fx.spark_web_raw(spark, sf)
    # a generated row: a filter on the line is not pushed below, where the line and its
    # cells would be made once more for each of the filter's terms
    return raw.select(F.explode(F.array(F.to_json(F.struct(*raw.columns)))).alias("value"))


def _records(spark, sf):
    records, _ = wt.parse_web_tables(_web_lines(spark, sf))
    return wt.clean_records(records)


def _web_tables(spark, sf, judged=None):
    """The seven relations, of the judged tables only where a join asks for no others
    (J5).  The records are parsed and cleaned once and stored; the relations read
    their columns of them."""
    records, _ = wt.parse_web_tables(_web_lines(spark, sf))
    records = records.drop("missing_keys")
    if judged is not None:
        records = wt.judged_only(records, judged)
    return wt.normalise(stored(wt.clean_records(records), "records"))


def _lossy_tables(spark, sf):
    t = _web_tables(spark, sf, _judgements(spark, sf))
    key = F.substring(F.col("json_loc"), 2, 20).cast("bigint")
    t["text_after"] = t["text_after"].where(key % DROP_RULE_MOD != DROP_RULE_REM)
    return t


def _judgements(spark, sf):
    return fx.spark_table_qrels(spark, sf)


# ---------------------------------------------------------------- SQL fixtures

_CLEAN = {
    "rel1": """SELECT *, list_filter(relation, lambda c: len(list_filter(c, lambda x: x IS DISTINCT FROM '')) > 0)
                 AS r1 FROM v_web_raw""",
    "webc": """SELECT * EXCLUDE (relation, r1),
                 list_transform(r1, lambda c: list_filter(c, lambda x, j:
                     j > coalesce(len(r1[1]), 0)
                     OR len(list_filter(r1, lambda d: j <= len(d) AND d[j] IS DISTINCT FROM '')) > 0)) AS relation
               FROM rel1""",
    "w_web_table": "SELECT json_loc, title, CAST(to_json(relation) AS VARCHAR) AS relation, tableType AS table_type FROM webc",
    "w_table_meta": """SELECT json_loc, hasKeyColumn AS has_key_column, keyColumnIndex AS key_column_index,
                              hasHeader AS has_header, headerPosition AS header_pos,
                              headerRowIndex AS header_row_index, tableOrientation AS table_orientation,
                              tableNum AS table_num, recordEndOffset AS record_end_offset,
                              recordOffset AS record_offset FROM webc""",
    "w_text_before": "SELECT json_loc, textBeforeTable AS text_before FROM webc",
    "w_text_after": "SELECT json_loc, textAfterTable AS text_after FROM webc",
    "w_lossy_after": f"""SELECT * FROM w_text_after
                        WHERE CAST(substr(json_loc, 2) AS BIGINT) % {DROP_RULE_MOD} <> {DROP_RULE_REM}""",
    "w_table_entities": "SELECT json_loc, entities FROM webc",
    "w_page_title": "SELECT json_loc, pageTitle AS page_title FROM webc",
    "w_page_url": "SELECT json_loc, url FROM webc",
    "w_attrs": """SELECT w.json_loc, w.title, w.relation, w.table_type, p.page_title, m.has_header, m.header_pos,
                         m.header_row_index, m.table_orientation, m.has_key_column, m.key_column_index,
                         b.text_before, a.text_after, e.entities, u.url
                  FROM w_web_table w JOIN w_page_title p ON p.json_loc = w.json_loc
                  JOIN w_table_meta m ON m.json_loc = w.json_loc
                  JOIN w_text_before b ON b.json_loc = w.json_loc
                  JOIN w_lossy_after a ON a.json_loc = w.json_loc
                  JOIN w_table_entities e ON e.json_loc = w.json_loc
                  JOIN w_page_url u ON u.json_loc = w.json_loc""",
}
_WV = ["v_web_raw", "v_table_qrels", "v_topics"]


def _sql(body, views=_WV):
    return fx.sql_with(views, body, _CLEAN)


# ---------------------------------------------------------------- parsing

@register("parse_jsonl_props", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def parse_jsonl_props(spark, sf):
    """JSON text column → typed field (fixed schema, never inferred)."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@register("parse_web_jsonl", fx.sql_with(["v_web_raw"], """
    SELECT json_loc, title, tableType, keyColumnIndex, headerRowIndex, hasHeader, pageTitle, url,
           CAST(len(relation) AS INTEGER) AS n_cols, 0 AS n_missing FROM v_web_raw"""))
def parse_web_jsonl(spark, sf):
    """JSON Lines dump → typed web-table records (+ missing-key flags)."""
    records, _ = wt.parse_web_tables(_web_lines(spark, sf))
    return records.select("json_loc", "title", "tableType", "keyColumnIndex", "headerRowIndex", "hasHeader",
                          "pageTitle", "url", F.size("relation").alias("n_cols"),
                          F.size(F.filter("missing_keys", lambda k: ~F.lit(k).isin("pageTitle", "url")))
                          .alias("n_missing"))


# ---------------------------------------------------------------- cell cleaning

@register("clean_relation", _sql("SELECT json_loc, relation FROM webc", ["v_web_raw"]))
def clean_relation(spark, sf):
    """F1 + F2: drop all-empty columns, then positions empty everywhere."""
    return _records(spark, sf).select("json_loc", "relation")


@register("relation_transpose", _sql("""
    SELECT json_loc,
           CASE WHEN len(relation) > 0 AND list_min(list_transform(relation, lambda c: len(c))) > 0
                THEN list_transform(range(1, list_min(list_transform(relation, lambda c: len(c))) + 1),
                                    lambda j: list_transform(relation, lambda c: c[j]))
                ELSE [] END AS rows
    FROM webc""", ["v_web_raw"]))
def relation_transpose(spark, sf):
    """Columns → rows (cut to the shortest column)."""
    return _records(spark, sf).select("json_loc", rel.transpose("relation").alias("rows"))


_NROWS = "CASE WHEN len(relation) > 0 THEN list_min(list_transform(relation, lambda c: len(c))) ELSE 0 END"


@register("header_text", _sql(f"""
    SELECT json_loc, CASE WHEN headerRowIndex = -1 THEN ''
                          WHEN hp >= 0 AND hp < nr
                          THEN array_to_string(list_transform(relation, lambda c: c[hp + 1]), ' ') END AS header
    FROM (SELECT *, {_NROWS} AS nr,
                 CASE WHEN headerRowIndex < 0 THEN {_NROWS} + headerRowIndex ELSE headerRowIndex END AS hp
          FROM webc)""", ["v_web_raw"]))
def header_text(spark, sf):
    return _records(spark, sf).select("json_loc", rel.header_text("relation", "headerRowIndex").alias("header"))


@register("key_column_text", _sql("""
    SELECT json_loc, CASE WHEN keyColumnIndex = -1 THEN ''
                          ELSE coalesce(CASE WHEN kp >= 0 AND kp < len(relation)
                                             THEN array_to_string(relation[kp + 1], ' ') END,
                                        array_to_string(relation[2], ' ')) END AS key_column
    FROM (SELECT *, CASE WHEN keyColumnIndex < 0 THEN len(relation) + keyColumnIndex
                         ELSE keyColumnIndex END AS kp FROM webc)""", ["v_web_raw"]))
def key_column_text(spark, sf):
    return _records(spark, sf).select("json_loc", rel.key_column_text("relation", "keyColumnIndex")
                                      .alias("key_column"))


@register("table_content", _sql("SELECT json_loc, array_to_string(flatten(relation), ' ') AS content FROM webc",
                                ["v_web_raw"]))
def table_content(spark, sf):
    return _records(spark, sf).select("json_loc", rel.table_content("relation").alias("content"))


@register("catchall", _sql("""
    SELECT json_loc AS docno,
           concat_ws(' ', array_to_string(flatten(relation), ' '), textBeforeTable, textAfterTable, pageTitle, title)
             AS catchall
    FROM webc""", ["v_web_raw"]))
def catchall(spark, sf):
    """Single-field document text per table."""
    r = _records(spark, sf)
    return r.select(F.col("json_loc").alias("docno"),
                    rel.catchall(rel.table_content("relation"), "textBeforeTable", "textAfterTable",
                                 "pageTitle", "title").alias("catchall"))


MULTI_FIELD = f"""
    SELECT json_loc AS docno, pageTitle AS page_title, textBeforeTable AS text_before,
           array_to_string(flatten(relation), ' ') AS text, textAfterTable AS text_after,
           CASE WHEN headerRowIndex = -1 THEN ''
                WHEN hp >= 0 AND hp < nr
                THEN array_to_string(list_transform(relation, lambda c: c[hp + 1]), ' ') END AS header
    FROM (SELECT *, {_NROWS} AS nr,
                 CASE WHEN headerRowIndex < 0 THEN {_NROWS} + headerRowIndex ELSE headerRowIndex END AS hp
          FROM webc)"""


@register("multi_field_corpus", _sql(MULTI_FIELD, ["v_web_raw"]))
def multi_field_corpus(spark, sf):
    """(docno, page_title, text_before, text, text_after, header)."""
    r = _records(spark, sf)
    return r.select(F.col("json_loc").alias("docno"), F.col("pageTitle").alias("page_title"),
                    F.col("textBeforeTable").alias("text_before"), rel.table_content("relation").alias("text"),
                    F.col("textAfterTable").alias("text_after"),
                    rel.header_text("relation", "headerRowIndex").alias("header"))


# ---------------------------------------------------------------- normalised relations

@register("normalised_seven", _sql(" UNION ALL ".join(
    f"SELECT '{n}' AS relation_name, count(*) AS n_rows FROM w_{n}"
    for n in ["web_table", "table_meta", "text_before", "text_after", "table_entities", "page_title",
              "page_url"]), ["v_web_raw"]))
def normalised_seven(spark, sf):
    """One record → seven relations; row counts per relation."""
    t = _web_tables(spark, sf)
    out = None
    for n, df in t.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("relation_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("table_meta", _sql("SELECT * FROM w_table_meta", ["v_web_raw"]))
def table_meta(spark, sf):
    return wt.normalise(_records(spark, sf))["table_meta"]


# ---------------------------------------------------------------- joins

@register("rated_tables_inner", _sql("""
    SELECT q.query, p.page_title, w.title, w.relation, w.table_type, m.has_header, b.text_before, a.text_after, e.entities,
           r.relevancy, r.json_loc, r.topic, 'HUMAN' AS annotator
    FROM v_table_qrels r JOIN v_topics q ON r.topic = q.qid
    JOIN w_web_table w ON w.json_loc = r.json_loc JOIN w_page_title p ON p.json_loc = r.json_loc
    JOIN w_table_meta m ON m.json_loc = r.json_loc JOIN w_text_before b ON b.json_loc = r.json_loc
    JOIN w_text_after a ON a.json_loc = r.json_loc JOIN w_table_entities e ON e.json_loc = r.json_loc"""))
def rated_tables_inner(spark, sf):
    """Judgements ⋈ topics ⋈ six table relations (inner)."""
    j = _judgements(spark, sf)
    return jn.rated_tables(j, fx.spark_topics(spark, sf), _web_tables(spark, sf, j))


@register("rated_tables_by_topic", _sql("""
    SELECT q.query, p.page_title, w.title, w.relation, w.table_type, m.has_header, b.text_before, a.text_after, e.entities,
           r.relevancy, r.json_loc, r.topic, 'HUMAN' AS annotator
    FROM v_table_qrels r JOIN v_topics q ON r.topic = q.qid
    JOIN w_web_table w ON w.json_loc = r.json_loc JOIN w_page_title p ON p.json_loc = r.json_loc
    JOIN w_table_meta m ON m.json_loc = r.json_loc JOIN w_text_before b ON b.json_loc = r.json_loc
    JOIN w_text_after a ON a.json_loc = r.json_loc JOIN w_table_entities e ON e.json_loc = r.json_loc
    WHERE r.topic = 7"""))
def rated_tables_by_topic(spark, sf):
    """The same join for one topic (filter pushed below the joins)."""
    j = _judgements(spark, sf)
    tables = _web_tables(spark, sf, j.where(F.col("topic") == 7))
    return jn.rated_tables(j, fx.spark_topics(spark, sf), tables, topic=7)


@register("tables_for_qrels_right", _sql("""
    SELECT a.json_loc AS _a, r.json_loc, a.title, a.relation, a.table_type, a.page_title, a.has_header, a.header_pos,
           a.header_row_index, a.table_orientation, a.has_key_column, a.key_column_index, a.text_before,
           a.text_after, a.entities, a.url, r.topic, r.iteration, r.relevancy, q.query,
           a.json_loc IS NULL AS missing
    FROM w_attrs a RIGHT JOIN v_table_qrels r ON a.json_loc = r.json_loc
    LEFT JOIN v_topics q ON q.qid = r.topic""").replace("SELECT a.json_loc AS _a, ", "SELECT "))
def tables_for_qrels_right(spark, sf):
    """J2+J3: every judgement with its table attributes (or missing=true)."""
    return jn.tables_for_qrels(_judgements(spark, sf), fx.spark_topics(spark, sf), _lossy_tables(spark, sf))


@register("missing_tables", _sql("""
    SELECT r.topic, r.iteration, r.json_loc, r.relevancy FROM v_table_qrels r
    WHERE NOT EXISTS (SELECT 1 FROM w_attrs a WHERE a.json_loc = r.json_loc)"""))
def missing_tables(spark, sf):
    """Judged tables absent from at least one relation (the reference raises)."""
    return jn.missing_tables(_judgements(spark, sf), _lossy_tables(spark, sf))


@register("judged_count_check", _sql("""
    SELECT n_judged, n_found, n_judged = n_found AS complete
    FROM (SELECT (SELECT count(*) FROM v_table_qrels) AS n_judged,
                 (SELECT count(*) FROM v_table_qrels r JOIN webc w ON w.json_loc = r.json_loc) AS n_found)""",
    ["v_web_raw", "v_table_qrels"]))
def judged_count_check(spark, sf):
    """As many judged tables found as judgements made."""
    j = _judgements(spark, sf)
    return jn.count_check(j, j.join(_records(spark, sf).select("json_loc"), "json_loc"))


@register("judged_semi_join", """
    SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)""")
def judged_semi_join(spark, sf):
    """Keep only judged items (semi join, before any costly cleaning)."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return wt.judged_only(docs, table(spark, sf, "labels"), key="doc_id")


@register("rated_flag", """
    SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) AS rated FROM documents d""")
def rated_flag(spark, sf):
    """Membership flag per item."""
    return jn.rated_flag(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
