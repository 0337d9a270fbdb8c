"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each
filter keeps its maximum over the window (max pooling), a softmax layer turns
the maxima into languages.  Trained in numpy on a bounded sample of labelled
windows; applied to batches of windows that cover every byte of every text.

A filter over one-hot bytes is a table look-up per offset, so prediction adds
rows of two byte-pair tables instead of multiplying.  A document's probability
is the mean over its windows, weighted by their bytes.

Rules: learned labels come only from rows whose crc32(doc_id as text) mod 3 is
not 1 and whose lang is not null; ``und`` with score 0 for null texts, texts
without a letter, and any text if there is nothing to learn from.  Repeated
rows get equal answers; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.llm.common import held_out, pick, ready, rows_of, stratified_sample, with_row

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
#: Bounds of the training sample: documents of a language, windows of a
#: document, windows in all.
PER_LANG, PER_DOC, MOST_WINDOWS = 800, 4, 40_000
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
MOD, REST = 3, 1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text number, bytes used): zero-padded windows of the lower-case
    UTF-8 bytes that overlap by the widest filter less one."""
    step = WINDOW - max(WIDTHS) + 1
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    count = [max(1, -(-(len(b) - max(WIDTHS) + 1) // step)) for b in raw]
    out = np.zeros((sum(count), WINDOW), np.uint8)
    used = np.zeros(len(out), np.int64)
    at = 0
    for b, n in zip(raw, count):
        a = np.frombuffer(b, np.uint8)
        for i in range(n):
            part = a[i * step:i * step + WINDOW]
            out[at, :len(part)] = part
            used[at] = len(part)
            at += 1
    return out, np.repeat(np.arange(len(raw)), count), used


class ByteCNN:
    """Filters ``w[width][offset, byte, filter]``, biases, softmax layer."""

    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(SEED)
        self.langs = langs
        self.w = {k: rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.b = np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters and where they are."""
        n = x.shape[1] - max(WIDTHS) + 1
        top, where = [], []
        for k in WIDTHS:
            conv = sum(self.w[k][o][x[:, o:o + n]] for o in range(k))
            at = conv.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        return np.concatenate(top, 1) + self.b, np.concatenate(where, 1)

    def train(self, x: np.ndarray, y: np.ndarray) -> "ByteCNN":
        rng = np.random.default_rng(SEED)
        params = [*self.w.values(), self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                part = order[i:i + BATCH]
                xb = x[part].copy()
                short = rng.random(len(part)) < 0.25  # also learn from short texts
                for r in np.flatnonzero(short):
                    xb[r, rng.integers(12, WINDOW):] = 0
                z, where = self._pooled(xb)
                h = np.maximum(z, 0)
                logit = h @ self.v + self.c
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                p /= len(part)
                dh = (p @ self.v.T) * (z > 0)
                grads = []
                for j, k in enumerate(WIDTHS):
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    g = np.empty_like(self.w[k])
                    for o in range(k):
                        byte = np.take_along_axis(xb, where[:, cols] + o, 1).astype(np.int64)
                        flat = byte * FILTERS + np.arange(FILTERS)
                        g[o] = np.bincount(flat.ravel(), dh[:, cols].ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for a, g, mi, si in zip(params, grads, m, s):  # Adam
                    mi += 0.1 * (g - mi)
                    si += 0.001 * (g * g - si)
                    a -= RATE * (mi / (1 - 0.9 ** step)) / (np.sqrt(si / (1 - 0.999 ** step)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of filter rows for the byte pairs at offsets (0, 1) and (2, 3)."""
        first, second = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        front = np.concatenate([self.w[k][0][first] + self.w[k][1][second] for k in WIDTHS], 1)
        back = np.concatenate([self.w[3][2][first], self.w[4][2][first] + self.w[4][3][second]], 1)
        return front, back

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], block: int = 64) -> np.ndarray:
        front, back = tables
        n = x.shape[1] - max(WIDTHS) + 1
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), block):
            b = x[i:i + block].astype(np.int32)
            pair = b[:, :-1] * 256 + b[:, 1:]
            conv = front.take(pair[:, :n], axis=0)
            conv[:, :, FILTERS:] += back.take(pair[:, 2:2 + n], axis=0)
            h = np.maximum(conv.max(axis=1) + self.b, 0)
            logit = h @ self.v + self.c
            p = np.exp(logit - logit.max(1, keepdims=True))
            out[i:i + block] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None], tables) -> tuple[list[str], np.ndarray]:
        has = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if has and self.langs:
            x, owner, used = windows_of([texts[i] for i in has])
            p = self.probabilities(x, tables) * used[:, None]
            total = np.zeros((len(has), len(self.langs)))
            np.add.at(total, owner, p)
            total /= np.bincount(owner, used, len(has))[:, None]
            for i, row in zip(has, total):
                j = int(row.argmax())
                lang[i], score[i] = self.langs[j], min(1.0, float(row[j]))
        return lang, score


def training_windows(docs: DataFrame) -> DataFrame:
    """(label, texts): up to PER_DOC pieces of WINDOW characters, evenly spaced,
    of at most PER_LANG documents of each language."""
    rows = (pick(docs, doc_id="bigint", text="string", lang="string")
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), MOD, REST)))
    sample = stratified_sample(rows, "lang", PER_LANG, "text")
    free = F.greatest(F.length("text") - WINDOW, F.lit(0))
    pieces = F.array_distinct(F.array(*[
        F.substring(F.col("text"), (1 + F.floor(free * i / max(1, PER_DOC - 1))).cast("int"), F.lit(WINDOW))
        for i in range(PER_DOC)]))
    return sample.select(F.col("lang").alias("label"), F.explode(pieces).alias("piece")).limit(MOST_WINDOWS)


def fit(docs: DataFrame) -> ByteCNN:
    rows = sorted((r.label, r.piece) for r in training_windows(docs).collect())
    rows = [r for r in rows if LETTER.search(r[1])]
    langs = sorted({r[0] for r in rows})
    model = ByteCNN(langs)
    if len(langs) > 1:
        x = np.zeros((len(rows), WINDOW), np.uint8)
        for i, (_, piece) in enumerate(rows):
            b = np.frombuffer(piece.lower().encode("utf-8", "replace")[:WINDOW], np.uint8)
            x[i, :len(b)] = b
        model.train(x, np.array([langs.index(r[0]) for r in rows]))
    return model


def predictor(model: ByteCNN, spark):
    """Column function text -> struct(lang string, score double)."""
    shared = spark.sparkContext.broadcast((model, model.tables()))  # 21 MB, whatever the input

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, tables = shared.value
        for texts in batches:
            lang, score = net.predict(texts.where(texts.notna(), None).tolist(), tables)
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify(docs: DataFrame, text: Column, model: ByteCNN | None = None) -> Column:
    """struct(lang, score) of ``text`` with a network learned from ``docs``."""
    ready(docs.sparkSession)
    return predictor(model or fit(docs), docs.sparkSession)(text)


#: A language is told from others with at least this probability.
ACCEPTED = 0.3


def known_language(docs: DataFrame) -> DataFrame:
    """The rows whose language is told, with the columns of ``docs``: ``und`` and
    answers below ACCEPTED go."""
    d = with_row(docs, text="string")
    d = d.select("row", identify(docs, F.col("text")).alias("p"))
    return rows_of(d.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= ACCEPTED)), docs.columns)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    d = pick(docs, doc_id="bigint", text="string")
    d = d.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"),
                 identify(docs, F.col("text")).alias("p"))
    return d.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
