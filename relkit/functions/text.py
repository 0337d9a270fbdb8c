"""Text column expressions: tokenizer, in-row term frequencies, token counts.

All functions return Columns built from Spark SQL built-ins (split, lower,
array_sort, filter, transform) so they stay inside whole-stage codegen; no
Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a token is a maximal run of Unicode letters / decimal digits
# (text is lower-cased first).  The same pattern is used by the SQL oracle.
TOKEN_SPLIT = r"[^\p{L}\p{Nd}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """lower → split on non letter/digit runs → drop empty tokens (and stop
    words when given).  Order and duplicates are kept (term frequencies need
    them), so ``array_except`` is never used here."""
    toks = F.array_remove(F.split(F.lower(_c(text)), TOKEN_SPLIT), "")
    if stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        toks = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    return toks


def add_term_frequencies(df: DataFrame, tokens: str, out: str = "tfs") -> DataFrame:
    """Add ``out`` = array<struct<term string, tf int>> computed inside the row:
    sort the tokens, find the run starts, run length = tf.

    O(n log n) per document and no shuffle: the postings of a document are
    produced on the partition that holds the document.  The sorted array and
    the run starts are projected as their own columns first so the lambdas
    below reference attributes (Catalyst does not collapse projections that
    would duplicate an expensive expression) instead of re-sorting per element.
    """
    s, st = f"_{out}_sorted", f"_{out}_starts"
    df = df.withColumn(s, F.sort_array(F.col(tokens)))
    n = F.size(F.col(s))
    df = df.withColumn(st, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i <= n) & ((i == 1) | (F.try_element_at(F.col(s), i)
                                          != F.try_element_at(F.col(s), i - 1))),
    ))
    df = df.withColumn(out, F.transform(
        F.col(st),
        lambda p, j: F.struct(
            F.try_element_at(F.col(s), p).alias("term"),
            (F.coalesce(F.try_element_at(F.col(st), j + 2), n + 1) - p).cast("int").alias("tf"),
        ),
    ))
    return df.drop(s, st)


def token_count(text: Column | str) -> Column:
    """Default token counter for prompt budgets: number of word tokens plus
    number of punctuation/symbol characters (a BPE-free approximation; an
    exact tokenizer can be plugged in through ``relkit.functions.prompt``)."""
    t = _c(text)
    return (F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{Nd}]+"), 0))
            + F.size(F.regexp_extract_all(t, F.lit(r"[^\p{L}\p{Nd}\s]"), 0))).cast("long")
