"""Toxicity by Levenshtein automata over a learned lexicon.

Lexicon: words, and stems of 4 to 6 characters with several endings, that occur
in many labelled toxic texts and almost no clean one.  Support is counted over
distinct texts (copies and near copies share the smallest hash of their words
and count once).

Matching: the lexicon is a trie; a Levenshtein automaton runs over it, so one
automaton reads a word and accepts every spelling within the edits a term's
length allows.  The product automaton is made deterministic step by step: a
state is built when a word first reaches it, then costs one look-up a letter.

Scoring: a hit between quotation marks, or after a reporting word, within a
window of WINDOW words counts as quoted.  A logistic model weighs exact,
misspelled and quoted hits; it starts from fixed weights and learns from the
labelled sample.

Rules: labels come only from rows whose crc32(doc_id as text) mod 5 is not 0;
null and empty texts score like a text without hits; without labelled toxic
rows there are no terms and every text scores the same, below 0.5.  Whole texts
are read.  Repeated rows get equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm.common import held_out, labelled, pick, ready

MOD, REST = 5, 0
#: Bounds: labelled documents of a class, terms of the lexicon.
PER_CLASS, MOST_TERMS = 2500, 5000
#: A term needs so many distinct toxic texts, so many times the clean share, and
#: this much evidence (nats: Poisson tail at the clean share, against chance hits
#: among many words); a stem needs so many endings.
SUPPORT, ODDS, EVIDENCE, ENDINGS = 3, 20.0, 12.0, 3
STEMS = (4, 5, 6)
WINDOW = 8
REMEMBERED = 1_000_000
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”«»„"
#: Words that report what others said (fixed list).
REPORTING = frozenset("said says called calls quote quoted quotes wrote term word insult dijo palabra sagte wort dit mot".split())
#: Prior weights of the score: none, exact, misspelled and quoted hits.
PRIOR, PRIOR_STRENGTH = np.array([-4.0, 3.0, 1.5, 0.5]), 3.0


def edits(length: int) -> int:
    """Edits that a term of this length allows."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Trie of terms, intersected with Levenshtein automata.

    A state is the set of (trie node, edits so far); ``best`` of a state is the
    fewest edits with which it accepts, or -1."""

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.allowed, self.word, self.stem = [-1], [-1], [False]
        for w in words:
            self.word[self._path(w, edits(len(w)))] = edits(len(w))
        for s in stems:
            self.stem[self._path(s, 0)] = True
        self.step: dict[tuple[int, str], int] = {}
        self.sets: list[frozenset] = []
        self.best: list[int] = []
        self.number: dict[frozenset, int] = {}
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0} if words or stems else {}))

    def _path(self, term: str, allow: int) -> int:
        at = 0
        self.allowed[0] = max(self.allowed[0], allow)
        for ch in term:
            if ch not in self.next[at]:
                self.next[at][ch] = len(self.next)
                self.next.append({})
                self.allowed.append(-1)
                self.word.append(-1)
                self.stem.append(False)
            at = self.next[at][ch]
            self.allowed[at] = max(self.allowed[at], allow)
        return at

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by letters that the text leaves out."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if state.get(node, 99) < e:
                continue
            for child in self.next[node].values():
                if e < self.allowed[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            fits = [e for n, e in key if e <= self.word[n]]
            if any(e == 0 and self.stem[n] for n, e in key):
                fits.append(0)
            self.best.append(min(fits, default=-1))
        return self.number[key]

    def _move(self, s: int, ch: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in self.sets[s]:
            if e == 0 and self.stem[node]:
                reach(node, 0)  # any ending follows a stem
            for c, child in self.next[node].items():
                reach(child, e if c == ch else e + 1)
            reach(node, e + 1)
        return self._state(self._closed(out))

    def match(self, word: str) -> int:
        """Fewest edits to a term, or -1."""
        if len(self.sets) > 200_000:  # bounds the memory of the states
            self.step, self.sets, self.best, self.number = {}, [], [], {}
            self.dead = self._state({})
            self.start = self._state(self._closed({0: 0}))
        s, step = self.start, self.step
        for ch in word:
            t = step.get((s, ch))
            if t is None:
                t = step[s, ch] = self._move(s, ch)
            s = t
            if s == self.dead:
                return -1
        return self.best[s]


class Scorer:
    """Scores of texts; remembers which chunks hold a hit (0: none, 1 + edits)."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights, self.seen = lexicon, weights, {}

    def _hit(self, chunk: str) -> int:
        found = [e for w in WORD.findall(chunk) if (e := self.lexicon.match(w)) >= 0]
        return 1 + min(found) if found else 0

    def counts(self, text: str) -> tuple[int, int, int]:
        """Exact, misspelled and quoted hits."""
        chunks = text.lower().split()
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        hits = list(map(self.seen.get, chunks))
        if None in hits:
            for i, h in enumerate(hits):
                if h is None:
                    if (h := self.seen.get(chunks[i])) is None:
                        h = self.seen[chunks[i]] = self._hit(chunks[i])
                    hits[i] = h
        if not any(hits):
            return 0, 0, 0
        exact = fuzzy = quoted = 0
        for i, h in enumerate(hits):
            if h:
                if self._quoted(chunks, i):
                    quoted += 1
                elif h == 1:
                    exact += 1
                else:
                    fuzzy += 1
        return exact, fuzzy, quoted

    @staticmethod
    def _quoted(chunks: list[str], i: int) -> bool:
        before, after = chunks[max(0, i - WINDOW):i + 1], chunks[i:i + WINDOW + 1]
        opened = sum(c.count(q) for c in before[:-1] for q in QUOTES) + sum(chunks[i].startswith(q) for q in QUOTES)
        closed = any(q in c for c in after[1:] for q in QUOTES) or any(q in chunks[i][1:] for q in QUOTES)
        near = any(w in REPORTING for c in before[-4:-1] for w in WORD.findall(c))
        return opened % 2 == 1 and closed or near

    @staticmethod
    def inputs(counts: list[tuple[int, int, int]]) -> np.ndarray:
        c = np.log2(1 + np.array(counts, float).reshape(-1, 3))
        return np.concatenate([np.ones((len(c), 1)), c], 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.inputs([self.counts(t) if t else (0, 0, 0) for t in texts])
        return 1 / (1 + np.exp(-(x @ self.weights)))


def evidence(sample: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): distinct texts of each class that hold a word
    or begin a word with a stem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: set[tuple[str, bool, int, int]] = set()
            for y, text in zip(f.y, f.text):
                words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
                if words:
                    like = min(zlib.crc32(w.encode()) for w in words)
                    got.update((w, False, y, like) for w in words)
                    got.update((s, True, y, like) for s in {w[:k] for w in words for k in STEMS if len(w) > k})
            yield pd.DataFrame(list(got), columns=["term", "stem", "y", "like"])

    rows = sample.mapInPandas(run, "term string, stem boolean, y int, like bigint").distinct()
    return rows.groupBy("term", "stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def lexicon(sample: DataFrame) -> Lexicon:
    texts = sample.groupBy().agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    toxic, clean = texts.t or 0, texts.c or 0
    share = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    n, chance = F.col("toxic"), (F.col("clean") + 1) / (clean + 1) * toxic
    sure = n * F.log(n / chance) - (n - chance)
    good = (evidence(sample).where((n >= SUPPORT) & (share >= ODDS) & (n > chance) & (sure >= EVIDENCE))
            .orderBy(F.desc(share), "term").limit(MOST_TERMS).collect())
    words = sorted(r.term for r in good if not r.stem)
    stems = []
    for s in sorted((r.term for r in good if r.stem), key=len):
        if not any(s.startswith(t) for t in stems) and sum(w.startswith(s) for w in words) >= ENDINGS:
            stems.append(s)
    return Lexicon([w for w in words if not any(w.startswith(s) for s in stems)], stems)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + PRIOR_STRENGTH * (w - PRIOR)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    w[1:] = np.maximum(w[1:], 0)  # a hit never speaks for a text
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    sample, rows = labelled(docs, labels, "toxic", MOD, REST, PER_CLASS)
    sample = sample.checkpoint()  # at most 2 * PER_CLASS texts, read twice
    lex = lexicon(sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lex, PRIOR)
        for f in frames:
            got = [scorer.counts(t) for t in f.text]
            yield pd.DataFrame({"y": f.y, **{k: [g[i] for g in got] for i, k in enumerate(("a", "b", "c"))}})

    got = sample.select("y", "text").mapInPandas(run, "y int, a int, b int, c int").groupBy("y", "a", "b", "c").count().collect()
    if not got:
        return Scorer(lex, PRIOR)
    y = np.array([r.y for r in got], float)
    n = np.array([r["count"] for r in got], float)
    taken = {k: n[y == k].sum() for k in (0, 1)}
    weight = n * np.array([rows[int(k)] / taken[int(k)] for k in y])  # as many as the sample stands for
    weight *= n.sum() / weight.sum()
    return Scorer(lex, fitted(Scorer.inputs([(r.a, r.b, r.c) for r in got]), y, weight))


def scorer(model: Scorer, spark: SparkSession):
    """Column function text -> score."""
    shared = spark.sparkContext.broadcast(model)  # at most MOST_TERMS terms

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.scores(texts.where(texts.notna(), None).tolist()))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    ready(docs.sparkSession)
    score = scorer(fit(docs, labels), docs.sparkSession)
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", score("text").alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
