"""Cell-matrix expressions for web tables.

A relation is ARRAY<ARRAY<STRING>> with the OUTER array = columns and the
inner arrays = cells.  An empty cell is '' and a null cell is NOT empty.
Indexes follow Python semantics: -1 means "none" for header/key, other
negative values count from the end, out-of-range gives null (the reference
raises there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _nonempty(x: Column) -> Column:
    return ~x.eqNullSafe(F.lit(""))


def drop_empty_outer(rel: Column | str) -> Column:
    """drop inner lists whose cells are all '' (null cells count as
    content; an empty inner list is dropped)."""
    return F.filter(_c(rel), lambda col: F.exists(col, _nonempty))


def clean_relation(df: DataFrame, rel: str = "relation", out: str = "relation") -> DataFrame:
    """F1 then F2 on column ``rel``.

    F2 drops the positions (candidates = positions of the first inner list)
    that are '' in every inner list that has them.  The per-position keep mask
    is computed once per record (O(cells)) and projected as its own column
    before the lambdas that read it; ragged lists are tolerated and an empty
    relation stays empty.  A list without '' that is as long as the first keeps
    every position, so no mask is made then."""
    keep = f"_{out}_keep"
    df = df.withColumn(out, drop_empty_outer(rel))
    r = F.col(out)
    first = F.try_element_at(r, F.lit(1))
    n0 = F.coalesce(F.size(first), F.lit(0))
    every = F.exists(r, lambda d: (F.size(d) >= n0) & ~F.coalesce(F.array_contains(d, ""), F.lit(False)))
    df = df.withColumn(keep, F.when(~F.coalesce(every, F.lit(False)), F.transform(
        F.sequence(F.lit(0), F.greatest(n0 - 1, F.lit(0))),
        lambda j: (j < n0) & F.exists(r, lambda d: (j < F.size(d)) & _nonempty(F.get(d, j))))))
    k = F.col(keep)
    df = df.withColumn(out, F.when(k.isNull(), r).otherwise(F.transform(
        r, lambda col: F.filter(col, lambda x, j: (j >= F.size(k)) | F.coalesce(F.get(k, j), F.lit(True))))))
    return df.drop(keep)


def n_rows(rel: Column | str) -> Column:
    """Number of rows after transposition (= shortest column; 0 if none)."""
    r = _c(rel)
    return F.when(F.size(r) > 0, F.array_min(F.transform(r, lambda col: F.size(col)))).otherwise(F.lit(0))


def transpose(rel: Column | str) -> Column:
    """zip(*relation) -- rows, cut to the shortest column."""
    r = _c(rel)
    n = n_rows(r)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1),
                                     lambda j: F.transform(r, lambda col: F.get(col, j)))) \
            .otherwise(F.array().cast("array<array<string>>"))


def _py_pos(idx: Column, n: Column) -> Column:
    """0-based position for a Python index into a sequence of length n
    (negative counts from the end); null when out of range."""
    pos = F.when(idx < 0, n + idx).otherwise(idx)
    return F.when((pos >= 0) & (pos < n), pos)


def header_text(rel: Column | str, idx: Column | str) -> Column:
    """the transposed row ``idx`` joined by a space; '' for -1."""
    r, i = _c(rel), _c(idx)
    pos = _py_pos(i, n_rows(r))
    row = F.transform(r, lambda col: F.get(col, pos))
    return F.when(i == -1, F.lit("")).when(pos.isNotNull(), F.array_join(row, " "))


def key_column_text(rel: Column | str, idx: Column | str) -> Column:
    """column ``idx`` joined by a space; '' for -1; when ``idx`` does not
    exist fall back to column 1."""
    r, i = _c(rel), _c(idx)
    pos = _py_pos(i, F.size(r))
    return F.when(i == -1, F.lit("")).otherwise(
        F.coalesce(F.array_join(F.get(r, pos), " "), F.array_join(F.get(r, F.lit(1)), " ")))


def table_content(rel: Column | str) -> Column:
    """every cell, column-major, joined by a space."""
    return F.array_join(F.flatten(_c(rel)), " ")


def catchall(content: Column | str, text_before: Column | str, text_after: Column | str,
             page_title: Column | str, title: Column | str) -> Column:
    """single-field document text (nulls are skipped)."""
    return F.concat_ws(" ", _c(content), _c(text_before), _c(text_after), _c(page_title), _c(title))


def strip_nul(c: Column | str) -> Column:
    """F16: remove NUL characters."""
    return F.when(F.contains(_c(c), F.lit("\u0000")), F.translate(_c(c), "\u0000", "")).otherwise(_c(c))


def strip_nul_cells(rel: Column | str) -> Column:
    """F16 for every cell; a relation without NUL is taken as it is."""
    r = _c(rel)
    clean = ~F.contains(F.array_join(F.flatten(r), ""), F.lit("\u0000"))
    return F.when(F.coalesce(clean, F.lit(False)), r).otherwise(
        F.transform(r, lambda c: F.transform(c, lambda x: F.translate(x, "\u0000", ""))))
