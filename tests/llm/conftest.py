"""Small document tables with the awkward cases that every operator must take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"

PROSE = {
    "en": "the river ran past the old house and the children played near the water every evening",
    "de": "der alte mann ging langsam durch den wald und dachte über die vergangenen jahre nach",
    "es": "el niño corría por la calle mientras su madre preparaba la comida en la cocina",
}


def prose(i: int, n: int = 60) -> str:
    """Different text for every i, in one of three languages."""
    words = list(PROSE.values())[i % 3].split()
    return " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] + (str(i * 31 + j) if j % 9 == 4 else "")
                    for j in range(n))


def table(spark, rows):
    """documents from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties,
    repeated rows."""
    rows = [(i, prose(i), list(PROSE)[i % 3], f"s{i % 3}") for i in range(1, 40)]
    rows += [(40, None, None, None), (41, "", "en", "s0"), (42, " \t\n", None, "s1"), (None, prose(3), None, None),
             (43, "1234 5678", "en", "s1"), (44, prose(1, 6000), "de", "s2"), (45, prose(2), "es", "s2"),
             (7, prose(7), "de", "s1"), (7, prose(7), "de", "s1"), (46, "é\U0001F600 ñ", "es", None)]
    return table(spark, rows)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with further columns whose names operators use themselves."""
    return awkward.selectExpr("*", "1 AS rid", "'x' AS digest", "2 AS size", "3 AS `row`", "4 AS TEXT_", "5 AS n",
                              "6 AS rep", "'k' AS keys", "7 AS src", "8 AS h", "9 AS part")


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 7 == 0)) for i in range(1, 40)]
    return spark.createDataFrame([*rows, (None, 1, 1), (3, None, None), (500, 1, 0), (5, 1, 0), (5, 1, 0)], LABELS)
