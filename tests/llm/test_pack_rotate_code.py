"""Best-fit packing, fill-in-the-middle and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pytest

from relkit.llm import best_fit, fill_middle, vector_codes

# -- best-fit packing -----------------------------------------------------


def plain_best_fit(lengths, size):
    """Room left in each sequence when every piece looks at all of them."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def rooms_of(pieces, size):
    """Room left per sequence of (sequence, offset, length); offsets without a gap."""
    by = {}
    for sequence, offset, n in pieces:
        by.setdefault(sequence, []).append((offset, n))
    rooms = []
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
        rooms.append(size - at)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_rules_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 16, 64, 100])
    lengths = [min(size, 1 + int(rng.expovariate(rng.choice([1, 4, 8]) / size))) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rules = sorted(best_fit.best_fit(counts, size))
    got = []
    for n, count in counts.items():
        for rank in range(count):
            _, first, sequence, each, offset = rules[bisect_right(rules, (n, rank, 1 << 60)) - 1]
            got.append((sequence + (rank - first) // each, offset + (rank - first) % each * n, n))
    assert rooms_of(got, size) == plain_best_fit(lengths, size)


def test_rules_do_not_grow_with_the_table():
    counts = {n: 10 ** 9 // n + n % 7 for n in range(1, 2049)}
    rules = len(best_fit.best_fit(counts))
    assert rules < 3 * 2048
    assert len(best_fit.best_fit({n: 1000 * c for n, c in counts.items()})) < 2 * rules


def test_tightest_room():
    tree = best_fit.Rooms(10)
    for room in (3, 3, 7, 10):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(8) is None


def test_ids_of_whole_texts():
    from tokenizers import Tokenizer
    rng, tok, enc = random.Random(3), Tokenizer.from_file(best_fit.vocabulary()), best_fit.Encoder(best_fit.vocabulary())
    blanks = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "​"]
    signs = ["a", "word", "'s", "’", "12", ".", "é", "漢字", "\U0001F600", "<|endoftext|>", "<|", "Ġ", "E"]
    for r in range(60):
        take = blanks[:6 if r % 2 else 13] + signs
        texts = ["".join(rng.choice(take) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        for text, raw in zip(texts, enc.encode(texts)):
            assert np.frombuffer(raw, enc.wide).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_round_trip(awkward, clashing, none):
    from tokenizers import Tokenizer
    tok, size = Tokenizer.from_file(best_fit.vocabulary()), 64
    rows = best_fit.pack(awkward, size=size).collect()
    lengths = [r.length for r in rows]
    assert rooms_of([(r.sequence_id, r.offset, r.length) for r in rows], size) == plain_best_fit(lengths, size)
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for doc_id, of in texts.items():
        ids = tok.encode(of[0], add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % size + 1
        want = sorted([0, *range(first, len(ids), size)] * len(of))
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in mine] == want and len(set(of)) == 1
        for r in mine:
            part = ids[r.start:r.start + (first if r.start == 0 else size)]
            raw = np.array(part, "<u4").tobytes()
            assert (r.length, r.ids, r.ids_crc32) == (len(part), raw, zlib.crc32(raw))
            assert r.piece == sorted(set(want)).index(r.start)
    assert sorted(r.length for r in best_fit.pack(clashing, size=size).collect()) == sorted(lengths)
    assert best_fit.pack(none).count() == 0


# -- fill in the middle -----------------------------------------------------


def test_exchange_in_place(monkeypatch):
    monkeypatch.setattr(fill_middle, "BUFFER", 3)
    rng = random.Random(4)
    for _ in range(500):
        raw = bytes(rng.randrange(256) for _ in range(rng.randint(0, 40)))
        a, b, c = sorted(rng.randint(0, len(raw)) for _ in range(3))
        buf = bytearray(raw)
        fill_middle.exchange(buf, a, b, c)
        assert bytes(buf) == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]


def test_forms_by_definition():
    rng, forms = random.Random(5), set()
    signs = ["a", "é", "\n", "\n\n", "\U0001F600", "<", "P>", "<S", ">", "<M>", " ", "word", "\r"]
    for _ in range(5000):
        text, doc_id = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14))), rng.randint(-9, 10 ** 9)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n, form, p, m, output = fill_middle.transformed(doc_id, text)
        forms.add(form)
        assert n == len(units) and fill_middle.restored(output, form) == text
        if text and not any(mark in text for mark in ("<P>", "<S>", "<M>")):
            h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
            low, high = sorted((int(h[:8], 16) % (n + 1), int(h[8:16], 16) % (n + 1)))
            a, b, c = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, n)))
            assert (p, m) == (len(a), len(b))
            want = "spm" if int(h[24:32], 16) % 100 < 50 else "psm"
            assert form == want
            assert output == (f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}")
        else:
            assert (form, p, m, output) == ("plain", None, None, text)
    assert forms == {"plain", "psm", "spm"}


def test_fill_middle_takes_awkward_rows(awkward, clashing, none):
    def rows(df):
        return sorted(map(str, df.collect()))
    got = rows(fill_middle.digests(awkward))
    assert len(got) == awkward.count() and rows(fill_middle.digests(clashing)) == got
    assert fill_middle.digests(none).count() == 0
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in awkward.collect())
    assert sorted(r.restored_sha256 for r in fill_middle.digests(awkward).collect()) == texts
    assert all(r.form == "plain" for r in fill_middle.fill_middle(awkward, rate=0).collect())


# -- vector codes -----------------------------------------------------------


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_nearest_entry(kind):
    rng = np.random.default_rng(6)
    for _ in range(60):
        d, k, n = rng.integers(1, 6), rng.integers(1, 60), rng.integers(1, 400)
        entries, x = rng.integers(-4, 5, (k, d)), rng.integers(-4, 5, (n, d))  # many ties
        index, far = vector_codes.Book(entries.astype(kind)).nearest(x.astype(kind))
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def plain_codes(rows, entries, rounds, parts=4, scale=1024):
    """{vec_id: (code, error, label_error)} and the digest, in Python integers."""
    rows = sorted(((i, [int(x * scale // 1) for x in v], g) for i, v, g in rows))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for c in cut:
                of.setdefault(nearest(c[p], book)[1], []).append(c[p])
            for i, held in of.items():
                book[i] = [sum(col) // len(held) for col in zip(*held)]
    out, total = {}, {}
    for (i, _, g), c in zip(rows, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g
        total[g] = total.get(g, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (code, error, total[g]) for i, (code, error, g) in out.items()}, digest


@pytest.mark.parametrize("spread", [1.0, 3e5, 1e9])
def test_codes_by_definition(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, spread, 8)], None if i % 5 == 0 else i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    want, digest = plain_codes(rows, 256, 4)
    got = vector_codes.vector_codes(df).collect()
    most = vector_codes.LONGEST
    want = {i: (code, min(error, most), min(total, most)) for i, (code, error, total) in want.items()}
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_awkward_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    good = [(i, [float(i % 7), 1.0, -2.5, float(i)], i % 2) for i in range(20)]
    bad = [(90, None, 1), (91, [1.0, None, 0.0, 0.0], 1), (92, [float("nan")] * 4, 1), (93, [float("inf")] * 4, None)]
    df = spark.createDataFrame([*good, *good[:3], (None, good[4][1], None), *bad], schema)
    got = vector_codes.vector_codes(df).collect()
    assert len(got) == 24 and {r.error for r in got} == {0}
    clash = df.selectExpr("*", "1 AS v", "2 AS of", "3 AS code", "4 AS `row`", "5 AS LABEL_", "6 AS part")
    assert sorted(map(str, vector_codes.vector_codes(clash).collect())) == sorted(map(str, got))
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame(bad, schema)).count() == 0
    uneven = spark.createDataFrame([(1, [], 1), (2, [0.5], 1), (3, [0.5, 0.0, 0.0, 0.0, 1.0], 1)], schema)
    assert {r.vec_id: r.error for r in vector_codes.vector_codes(uneven).collect()} == {1: 0, 2: 0, 3: 0}
    hollow = spark.createDataFrame([(1, [], 1), (2, [], None)], schema)
    assert {(r.code, r.error) for r in vector_codes.vector_codes(hollow).collect()} == {("00000000", 0)}
    huge = spark.createDataFrame([(i, [1e300 * i] * 4, 1) for i in range(300)], schema.replace("float", "double"))
    assert max(r.error for r in vector_codes.vector_codes(huge).collect()) == vector_codes.LONGEST
