"""Fill-in-the-middle by in-place block rotation.

A text is cut into lines, and two cuts drawn from the document's id divide it
into prefix, middle and suffix.  The bytes of the text stand in one bytearray:
``<P>``, ``<M>`` and ``<S>`` are inserted at the start and at both cuts, which
gives ``<P>prefix<M>middle<S>suffix``; exchanging its last two blocks gives the
psm form ``<P>prefix<S>suffix<M>middle``, and exchanging the first two of that the
spm form ``<S>suffix<P>prefix<M>middle``.  Two neighbouring blocks are exchanged
by reversing each and then both together, in place, with a buffer of fixed size.

Restoring finds the marks (a text that holds one stays plain, and no mark can
arise where a text meets another), rotates back in the opposite order and takes
the marks out, so the text is rebuilt from output and form alone.

Rules: null text is empty; an empty text, or one with a mark in it, is plain: its
output is the text, its cuts are null.  Lines are ``[^\\n]*\\n|[^\\n]+``; a
document of n lines has n + 1 places to cut, equal cuts give an empty middle.
A null doc_id counts as the empty string.  Repeated rows give equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import pick, ready

#: Of 100 documents so many are transformed, and of these so many to spm.
RATE, SPM, SEED = 100, 50, 7
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal holds apart from the text.
BUFFER = 1 << 16


def reverse(buf: bytearray, start: int, end: int) -> None:
    """Reverse ``buf[start:end]`` in place: blocks from both ends change places."""
    while end - start > 1:
        n = min(BUFFER, (end - start) // 2)
        left = buf[start:start + n]
        buf[start:start + n] = buf[end - n:end][::-1]
        left.reverse()
        buf[end - n:end] = left
        start, end = start + n, end - n


def exchange(buf: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange ``buf[start:middle]`` with ``buf[middle:end]`` by three reversals."""
    reverse(buf, start, middle)
    reverse(buf, middle, end)
    reverse(buf, start, end)


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in range(0, 16, 4)]


def lines(raw: bytes) -> int:
    return raw.count(b"\n") + (not raw.endswith(b"\n") if raw else 0)


def after(raw: bytes, units: int, n: int, start: int = 0) -> int:
    """Place behind so many more of the ``n`` lines, from ``start`` on."""
    if units == n:
        return len(raw)
    for _ in range(units):
        start = raw.index(b"\n", start) + 1
    return start


def transformed(doc_id: int | None, text: str, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple:
    """(n, form, prefix characters, middle characters, output)"""
    raw = text.encode("utf-8", "surrogatepass")
    n = lines(raw)
    h1, h2, h3, h4 = drawn(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p = after(raw, low, n)
    m = len(raw) if high == n else after(raw, high - low, n, p)
    chars = len(raw[:p].decode("utf-8", "surrogatepass")), len(raw[p:m].decode("utf-8", "surrogatepass"))
    buf = bytearray(raw)
    buf[m:m] = SUFFIX
    buf[p:p] = MIDDLE
    buf[0:0] = PREFIX
    p, m = p + 3, m + 6  # where <M> and <S> stand now
    exchange(buf, p, m, len(buf))
    form = "psm"
    if h4 % 100 < spm:
        exchange(buf, 0, p, p + len(buf) - m)
        form = "spm"
    return n, form, *chars, buf.decode("utf-8", "surrogatepass")


def restored(output: str, form: str) -> str:
    """The text, from output and form."""
    if form == "plain":
        return output
    buf = bytearray(output.encode("utf-8", "surrogatepass"))
    m = buf.index(MIDDLE)
    if form == "spm":
        exchange(buf, 0, buf.index(PREFIX), m)
    s = buf.index(SUFFIX)
    exchange(buf, s, m, len(buf))
    m = buf.index(MIDDLE)
    for mark in (buf.index(SUFFIX), m, 0):  # from the back, so that places hold
        del buf[mark:mark + 3]
    return buf.decode("utf-8", "surrogatepass")


FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """FORMS for every row of ``docs``, in the same task it is read."""
    ready(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in FORMS.split(", ")]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [(i, *transformed(i, t or "", rate, spm, seed)) for i, t in zip(ids, b.column("text").to_pylist())]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, FORMS)


def restore(output: str | Column, form: str | Column) -> Column:
    """Column of the texts, rebuilt from outputs and forms."""
    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def digests(docs: DataFrame) -> DataFrame:
    """``fill_middle`` with digests of the output and of the text restored from it."""
    out = fill_middle(docs)
    sha = {"output_sha256": F.col("output"), "restored_sha256": restore("output", "form")}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      *[F.sha2(c.cast("binary"), 256).alias(k) for k, c in sha.items()])


#: DuckDB SQL of ``digests`` over ``documents``.
ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents),
c AS (
    SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
    FROM d),
p AS (
    SELECT doc_id, t, n,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100
                THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1:least(c1, c2)], '') AS prefix,
           array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
           array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
    FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
