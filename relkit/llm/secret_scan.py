"""Secrets: fixed patterns, and long tokens told from ordinary identifiers by the
log-likelihood ratio of two character Markov models.

Both models learn from labelled samples of the whole corpus.  Random strings are the
values that the fixed patterns find, and strings drawn over the usual alphabets of
keys, so that an alphabet the corpus lacks is known too.  Ordinary ones are the
commonest tokens of all documents, digits included, that are too short to be judged
and no value of a fixed pattern: as they stand, in upper case and title case, and
joined as identifiers are (``a_b``, ``a-b``, ``aB``, ``a/b``); and dates and times.  Half of
each class trains.  A token that no fixed pattern covers is a secret when the ratio a
character exceeds the threshold, which the held-back halves set; ``Ratio.recall`` and
``Ratio.alarms`` are the shares of these that exceed it.

Spans are code points, end exclusive.  Rules: null text is empty and has no
spans; whole texts are read; without documents to learn from no token is added
to the fixed patterns; repeated rows get equal spans; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm.common import Covered, pick, ready, written

KINDS = ("assign", "access", "hex", "markov")
#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Tokens that the models judge.
LONG = re.compile(r"(?<!\S)\S{16,}")
TOKEN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
#: Bounds of the training sample: identifiers; random strings drawn, and as many of the
#: corpus (of the smallest hashes), of which PART characters are learned from.
IDENTIFIERS, STRINGS, PART = 60_000, 6_000, 64
#: Tokens below the length that is judged.
SHORT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,15}(?![A-Za-z0-9+/_=-])"
SEED = 5
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base 36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper base 36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base 62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base 64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "url base 64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}
#: The threshold lets at most the first share of the held-back ordinary class pass, and
#: lies no lower than needed to keep all but the second share of the held-back strings.
ERROR, MISSED = 1e-4, 0.01
#: Dates and times drawn for the ordinary class, in these forms.
STAMPS = 6_000
FORMS = ("%Y-%m-%dT%H-%M-%SZ", "%Y%m%dT%H%M%SZ", "%Y/%m/%d/%H-%M-%S", "%Y-%m-%d_%H%M%S")


class Markov:
    """First-order model over ASCII; row 0 is the start."""

    def __init__(self, samples: list[str]):
        n = np.full((128, 128), 0.05)
        for s in samples:
            c = np.frombuffer(("\0" + s).encode("ascii"), np.uint8)
            np.add.at(n, (c[:-1], c[1:]), 1)
        self.log = np.log(n[:, 33:] / n[:, 33:].sum(1, keepdims=True))

    def nats(self, token: str) -> float:
        c = np.frombuffer(("\0" + token).encode("ascii"), np.uint8)
        return float(self.log[c[:-1], c[1:] - 33].sum())


class Ratio:
    """Log-likelihood ratio a character of random string to identifier."""

    def __init__(self, identifiers: list[str], strings: list[str]):
        # one half of each trains, the other one sets the threshold and measures
        plain = Markov(identifiers[::2])
        random = Markov(strings[::2])
        self.log = random.log - plain.log
        judged = [self.of(x) for x in identifiers[1::2] if len(x) >= 16]
        values = [self.of(x) for x in strings[1::2] if len(x) >= 16]
        self.least = float(max(np.quantile(judged, 1 - ERROR), np.quantile(values, MISSED))) if judged and values else np.inf
        self.recall = float(np.mean(np.array(values) > self.least)) if values else None
        self.alarms = float(np.mean(np.array(judged) > self.least)) if judged else None

    def of(self, token: str) -> float:
        c = np.frombuffer(("\0" + token).encode("ascii"), np.uint8)
        return float(self.log[c[:-1], c[1:] - 33].sum()) / len(token)

    def secret(self, token: str) -> bool:
        if token.isdigit() or len(set(token)) < 8:
            return False  # numbers and rules such as ======
        return self.of(token) > self.least


def random_strings(n: int) -> list[str]:
    rng, names = np.random.default_rng(SEED), list(ALPHABETS)
    out = []
    for i in range(n):
        letters = np.array(list(ALPHABETS[names[i % len(names)]]))
        out.append("".join(rng.choice(letters, int(rng.integers(16, 48)))))
    return out


def stamps(n: int) -> list[str]:
    """Dates and times as names of files and versions hold them."""
    at = np.random.default_rng(SEED).integers(0, 4_000_000_000, n)
    return [datetime.fromtimestamp(int(t), UTC).strftime(FORMS[i % len(FORMS)]) for i, t in enumerate(at)]


def identifiers(words: list[str]) -> list[str]:
    """Ordinary identifiers made of words, and dates and times, labelled as such."""
    rng = np.random.default_rng(SEED)
    if not words:
        return []
    out = stamps(STAMPS) + [f(w) for w in words for f in (str, str.upper, str.title)]
    for i in range(min(IDENTIFIERS - len(out), 8 * len(words)) if len(out) < IDENTIFIERS else 0):
        few = [words[j] for j in rng.integers(0, len(words), int(rng.integers(2, 6)))]
        out.append((lambda: "_".join(few), lambda: "-".join(few), lambda: "/".join(few),
                    lambda: "_".join(few).upper(), lambda: few[0] + "".join(w.title() for w in few[1:]),
                    lambda: few[0] + str(rng.integers(1, 100)) + "-".join(few[1:]))[i % 6]())
    rng.shuffle(out)
    return out


def values(text: str) -> set[str]:
    """What the fixed patterns find, of each the first PART characters; of an
    assignment its value."""
    found = scan(text, None)
    return {(ASSIGN.match(text, s).group(2) if kind == 0 else text[s:e])[:PART] for s, kind, e in found}


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """(ordinary tokens, values of the fixed patterns) of all documents.  Whole texts
    are read; only the two bounded samples come to the driver."""
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(values(t)) for t in texts.fillna("")], dtype=object)

    d = pick(docs, text="string")
    labelled = written(d.select(F.explode(found("text")).alias("w")).distinct(), "secret-values")
    tokens = (d.select(F.explode(F.regexp_extract_all("text", F.lit(SHORT), F.lit(0))).alias("w"))
              .groupBy("w").count().join(labelled, "w", "left_anti")
              .groupBy(F.lower("w").alias("w")).agg(F.sum("count").alias("n")))
    common = tokens.orderBy(F.desc("n"), "w").limit(IDENTIFIERS // 4).collect()
    few = labelled.orderBy(F.xxhash64("w"), "w").limit(STRINGS).collect()
    return [r.w for r in common], [r.w for r in few]


def fit(docs: DataFrame) -> Ratio:
    ordinary, found = sample(docs)
    strings = random_strings(STRINGS) + [x for x in found if len(x) >= 16]
    np.random.default_rng(SEED).shuffle(strings)
    return Ratio(identifiers(ordinary), strings)


def scan(text: str, model: Ratio | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    tokens = []
    for run in LONG.finditer(text):  # no pattern below holds a blank
        at, part = run.start(), run.group()
        if len(part) >= HEX_LEAST:
            spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= HEX_LEAST]
        if model is not None:
            tokens += [(at + m.start(), at + m.end()) for m in TOKEN.finditer(part) if model.secret(m.group())]
    if tokens:
        base = Covered([(s, e) for s, _, e in spans])
        spans += [(s, 3, e) for s, e in tokens if base.free(s, e)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base string, spans string"


def scanner(model: Ratio | None, spark: SparkSession):
    """Column function text -> struct of RESULT."""
    shared = spark.sparkContext.broadcast(model)  # one 128 x 95 table

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out = []
            for t in texts.fillna(""):
                spans = scan(t, m)
                n = [sum(1 for s in spans if s[1] == k) for k in range(4)]
                out.append((*n, joined([s for s in spans if s[1] < 3]), joined(spans)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return find


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov per row."""
    ready(docs.sparkSession)
    find = scanner(fit(docs), docs.sparkSession)
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", find("text").alias("r"))
    return d.select("doc_id", "r.n_assign", "r.n_access", "r.n_hex",
                    F.sha2(F.col("r.base").cast("binary"), 256).alias("base_sha256"), "r.spans", "r.n_markov")
