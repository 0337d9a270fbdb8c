"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

The seeds' surroundings induce lexical patterns: the two words before, the two
words behind, and one on each side.  Patterns and the identifiers found in them
form a graph over all documents, scored in Spark round by round: a pattern with
enough known identifiers is as reliable as their share of all it surrounds, shrunk
by a fixed number of pseudo-observations; an identifier is as likely as its admitted
patterns make it together (noisy or), and a likely one is known from then on and
supports further patterns, until nothing is added.  Known identifiers of a fitting
form that a reliable pattern surrounds, and that no fixed pattern covers, are added
as ``found_<kind>``.

The graph's edges are distinct (pattern, identifier) pairs, counted with partial
aggregation, so a pattern with a third of all occurrences is no hot task and
copies of a text add nothing.  Nothing of the graph comes to the driver.

Spans are code points, end exclusive.  Rules: null text is empty and has no
spans; whole texts are read; repeated rows get equal spans; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import Covered, pick, ready, written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# begins at a run of digits: where the run's first digit begins no match, no later one does
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

#: What may be an identifier that no fixed pattern covers, by form.
FORMS = (
    ("email", re.compile(r"(?<![^\s@])[^\s@]{1,64}(?:@|\(at\)|\[at\])[^\s@]{1,255}")),
    ("ip", re.compile(r"[0-9]{1,3}(?:[.:][0-9]{1,3}){3,5}")),
    ("phone", re.compile(r"\(?[0-9]{2,4}\)?(?:[\x20./-]?[0-9]{2,4}){2,5}")),
    ("card", re.compile(r"[0-9]{4}(?:[\x20.-]?[0-9]{3,6}){2,4}")),
)
WORD = re.compile(r"\w+")
CONTEXT = 48  # code points on each side in which the two words are looked for
#: A pattern needs so many known identifiers; pseudo-observations; thresholds.
SUPPORT, SHRINK, RELIABLE, LIKELY = 4, 1.0, 0.75, 0.75


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping ``local@domain``, each text position read once:
    from every @ to the left as far as a local part goes."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)  # what lies before this @ cannot begin a later match
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            spans += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                      if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = NOT_DIGIT.sub("", m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                      if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(spans)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    before = WORD.findall(text[max(0, start - CONTEXT):start].lower())[-2:]
    behind = WORD.findall(text[end:end + CONTEXT].lower())[:2]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if len(behind) == 2:
        out.append(f"_ {behind[0]} {behind[1]}")
    if before and behind:
        out.append(f"{before[-1]} _ {behind[0]}")
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind, seed, identifier, patterns) of the seeds and of what
    has the form of an identifier outside them."""
    out = [(s, e, KINDS[k], True, text[s:e], contexts(text, s, e)) for s, k, e in base]
    if not ("@" in text or "[at]" in text or "(at)" in text or DIGIT.search(text)):
        return out
    covered = [(s, e) for s, _, e in base]
    for kind, form in FORMS:
        if kind == "email" and not ("@" in text or "[at]" in text or "(at)" in text):
            continue
        taken = Covered(covered)
        for m in form.finditer(text):
            s, e = m.span()
            alone = not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
            if alone and taken.free(s, e):
                out.append((s, e, kind, False, m.group(), contexts(text, s, e)))
                covered.append((s, e))
    return out


READ = ("base array<struct<start:int,kind:int,end:int>>, "
        "found array<struct<start:int,end:int,kind:string,seed:boolean,identifier:string,patterns:array<string>>>")


def reader():
    """Column function text -> struct of READ."""
    @F.pandas_udf(READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t) for t in texts.fillna("")]
            found = [occurrences(t, b) for t, b in zip(texts.fillna(""), base)]
            yield pd.DataFrame({
                "base": [[dict(zip(("start", "kind", "end"), x)) for x in b] for b in base],
                "found": [[dict(zip(("start", "end", "kind", "seed", "identifier", "patterns"), x)) for x in f]
                          for f in found]})

    return read


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, p) of the admitted patterns and (identifier, kind) of what is
    known, from (pattern, identifier, kind, seed) of the occurrences, where seed
    tells that a fixed pattern found it.

    The seeds are known first.  Each round counts every pattern's support anew, the
    known identifiers of the kind: with SUPPORT of them, p(pattern, kind) = support /
    (all its identifiers + SHRINK), and from RELIABLE / 2 on the pattern is admitted.
    p(identifier) = 1 - prod(1 - p(pattern)) over admitted patterns; from LIKELY on it
    is known and supports patterns in the next round.  What is known only grows, so
    the rounds end exactly when its number stays."""
    edges = edges.groupBy("pattern", "identifier", "kind").agg(F.max("seed").alias("seed"))
    counts = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy("pattern").agg(F.sum("n").alias("size"))
    # a pattern of fewer identifiers than SUPPORT can never be admitted
    enough = counts.where(F.col("n") >= SUPPORT).join(size, "pattern").drop("n")
    seeds = written(edges.where("seed").select("identifier", "kind").distinct(), "pii-seeds")
    graph = written(edges.join(enough, ["pattern", "kind"]).drop("seed"), "pii-graph")
    likely = F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.0) - F.col("p"))))  # p is below 1 by SHRINK
    known, n = seeds, seeds.count()
    while True:
        patterns = written(
            graph.join(known, ["identifier", "kind"], "left_semi").groupBy("pattern", "kind", "size")
            .agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
            .select("pattern", "kind", (F.col("support") / (F.col("size") + SHRINK)).alias("p"))
            .where(F.col("p") >= RELIABLE / 2), "pii-patterns")
        found = (graph.join(patterns, ["pattern", "kind"]).groupBy("identifier", "kind")
                 .agg(F.round(likely, 9).alias("p")).where(F.col("p") >= LIKELY).drop("p"))
        known, before = written(seeds.unionByName(found).distinct(), "pii-known"), n
        n = known.count()
        if n == before:
            return patterns, known


def discovered(rows: DataFrame) -> DataFrame:
    """(rid, start, end, kind) of identifiers beyond the fixed patterns."""
    found = rows.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    flat = found.select("rid", "start", "end", "kind", "seed", F.sha2("identifier", 256).alias("identifier"),
                        F.explode("patterns").alias("pattern"))
    patterns, known = scored(flat.select("pattern", "identifier", "kind", "seed"))
    return (flat.where(~F.col("seed"))
            .join(patterns.where(F.col("p") >= RELIABLE).select("pattern", "kind"), ["pattern", "kind"])
            .join(known, ["identifier", "kind"], "left_semi")
            .select("rid", "start", "end", "kind").distinct())


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found per row."""
    ready(docs.sparkSession)
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", reader()("text").alias("r"))
    rows = written(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "r.base", "r.found"), "pii")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") + 3
    extra = (discovered(rows).groupBy("rid")
             .agg(F.collect_list(F.struct("start", order.alias("kind"), "end")).alias("extra")))  # of one document
    names = F.array(*[F.lit(k) for k in (*KINDS, *(f"found_{k}" for k in KINDS))])

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: int):
        # one argument only: a second one would be the place in the array
        return F.size(F.filter("base", lambda x: x["kind"] == kind))

    count = [of(i).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    extra_or_none = F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.drop("found").join(extra, "rid", "left").select(
        "doc_id", *count, F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat("base", extra_or_none))).alias("spans"),
        F.size(extra_or_none).cast("bigint").alias("n_found"))
