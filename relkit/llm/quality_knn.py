"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed features of its form: trigrams of character classes,
and counts of repeated words, repeated lines and word lengths.  Their tf-idf
weights (of form alone, no words) are projected on the leading singular vectors of a bounded labelled
sample.  The sample's vectors are broadcast; every document's vector meets all
of them in blocks of exact cosine products, and the nearest vote with their
similarity as weight.

Rules: labels come only from rows whose crc32(doc_id as text) mod 3 is not 1;
the sample has at most PER_CLASS documents a class, and a vote counts for as
many labelled rows as its sample row stands for.  Null and empty texts, texts
without any neighbour, and any text where nothing is labelled get the share of
label 1 among the labelled rows (0.5 without labels).  Whole texts are read.
Repeated rows get equal scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm.common import held_out, labelled, pick, ready

#: Bounds of the broadcast: rows a class, dimensions (float32): 2 * 1500 * 32 * 4 bytes.
PER_CLASS, DIMS = 1500, 32
NEAREST, SHARPNESS, BLOCK = 21, 4, 256
MOD, REST = 3, 1
BINS = 1 << 14
#: Bins behind the hashed trigrams for the counts of words and lines.
EXTRA = 24
SEED = 11


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; everything above is class 7."""
    out = np.full(0x251, 7, np.uint32)
    for c in range(0x250):
        ch = chr(c)
        if ch.islower():
            out[c] = 0
        elif ch.isupper():
            out[c] = 1
        elif ch.isdigit():
            out[c] = 2
        elif ch == "\n":
            out[c] = 4
        elif ch.isspace():
            out[c] = 3
        elif ch.isprintable() and c < 128:
            out[c] = 8 + c - 32  # each mark is a class of its own
        else:
            out[c] = 6
    return out


CLASSES = _classes()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of a text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = CLASSES[np.minimum(code, 0x250)]
    tri = ((c[:-2] * 128 + c[1:-1]) * 128 + c[2:]) * np.uint32(2654435761) >> np.uint32(18)
    counts = np.bincount(tri, minlength=BINS + EXTRA).astype(np.float32)
    words = text.lower().split()
    n = len(words)
    if n:
        same = sum(map(str.__eq__, words, words[1:]))
        over = sum(map(str.__eq__, words, words[2:]))
        lines = text.split("\n")
        e = counts[BINS:]
        e[0], e[1], e[2] = same, over, len(lines) - len(set(lines))
        # shares come as one of a few bins: different words, mean length, marks
        e[3 + min(4, int(5 * len(set(words)) / n))] = 20 if n >= 20 else 5
        e[8 + min(7, int(len(text) / n / 3))] = 5
        e[16 + min(7, int(16 * sum(map(str.isalpha, words)) / n / 2))] = 5
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


class Model:
    """idf of the bins, projection, vectors and votes of the sample."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], weight: dict[int, float], base: float):
        self.base = base
        df = np.zeros(BINS + EXTRA, np.int64)
        for bins, _ in rows:
            df[bins] += 1
        used = np.flatnonzero(df >= 2)
        self.place = np.full(BINS + EXTRA, -1, np.int64)
        self.place[used] = np.arange(len(used))
        self.idf = np.log((1 + len(rows)) / (1 + df[used])).astype(np.float32) + 0.1
        x = np.zeros((len(rows), len(used)), np.float32)
        for i, r in enumerate(rows):
            at, v = self._weights(*r)
            x[i, at] = v
        rank = min(DIMS, *x.shape)
        if not rank:
            self.vectors, self.project = np.zeros((0, 1), np.float32), np.zeros((len(used), 1), np.float32)
            return
        rng = np.random.default_rng(SEED)
        q = x.T @ rng.normal(size=(len(rows), min(rank + 10, len(rows)))).astype(np.float32)
        for _ in range(3):  # randomized subspace iteration
            q, _ = np.linalg.qr(q)
            q = x.T @ (x @ q)
        q, _ = np.linalg.qr(q)
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.project = np.ascontiguousarray((q @ vt.T)[:, :rank], np.float32)
        v = x @ self.project
        length = np.linalg.norm(v, axis=1)
        keep = length > 0
        self.vectors = v[keep] / length[keep, None]
        self.y = np.array(y, np.float32)[keep]
        self.weight = np.array([weight[k] for k in y], np.float32)[keep]

    def _weights(self, bins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[bins]
        known = at >= 0
        at = at[known]
        v = np.log1p(counts[known]) * self.idf[at]
        return at, v / max(1e-9, float(np.linalg.norm(v)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if not len(self.vectors):
            return out
        vec = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, t in enumerate(texts):
            if t:
                at, v = self._weights(*features(t))
                vec[i] = v @ self.project[at]
        length = np.linalg.norm(vec, axis=1)
        k = min(NEAREST, len(self.vectors))
        for i in range(0, len(texts), BLOCK):
            rows = i + np.flatnonzero(length[i:i + BLOCK] > 0)
            cos = (vec[rows] / length[rows, None]) @ self.vectors.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:]
            vote = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS * self.weight[near]
            total = vote.sum(1)
            ok = total > 0
            out[rows[ok]] = (vote * self.y[near]).sum(1)[ok] / total[ok]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, counts = labelled(docs, labels, "quality", MOD, REST, PER_CLASS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features(t) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "y": f.y, "bins": [b for b, _ in got], "counts": [c for _, c in got]})

    # what is collected is at most 2 * PER_CLASS rows of at most BINS + EXTRA counts
    found = sample.where(F.length("text") > 0).mapInPandas(run, "doc_id bigint, y int, bins array<bigint>, counts array<float>")
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    y = [r.y for r in rows]
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    return Model([(np.array(r.bins), np.array(r.counts, np.float32)) for r in rows], y,
                 {k: counts[k] / max(1, y.count(k)) for k in counts}, base)


def scorer(model: Model, spark: SparkSession):
    """Column function text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.scores(texts.where(texts.notna(), None).tolist()))

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    ready(docs.sparkSession)
    score = scorer(fit(docs, labels), docs.sparkSession)
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", score("text").alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
