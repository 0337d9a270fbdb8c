"""SQL snippets for the DuckDB oracle (agreement statistics written in SQL)."""

from __future__ import annotations

from collections.abc import Sequence


def _by(by: Sequence[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return "".join(f"{p}{c}, " for c in by)


def kappa_ctes(pairs: str, a: str = "human", b: str = "pred", by: Sequence[str] = (),
               prefix: str = "k") -> dict[str, str]:
    """CTEs computing the zero-filled confusion (``{prefix}_conf``) and κ
    (``{prefix}_kappa``) from a pairs relation."""
    byp = _by(by)
    on_by = " AND ".join([f"x.{c} = y.{c}" for c in by]) or "TRUE"
    on_c = " AND ".join([f"c.{c} = x.{c}" for c in by] + [f"c.{a} = x.l", f"c.{b} = y.l"])
    grp = ", ".join(by)
    return {
        f"{prefix}_cnt": f"""SELECT {byp}{a}, {b}, count(*) AS n FROM {pairs}
                              WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL""",
        f"{prefix}_labs": f"""SELECT DISTINCT {byp}l FROM (
                                SELECT {byp}{a} AS l FROM {prefix}_cnt
                                UNION ALL SELECT {byp}{b} AS l FROM {prefix}_cnt)""",
        f"{prefix}_conf": f"""SELECT {_by(by, 'x')}x.l AS {a}, y.l AS {b}, CAST(coalesce(c.n, 0) AS BIGINT) AS n
                               FROM {prefix}_labs x JOIN {prefix}_labs y ON {on_by}
                               LEFT JOIN {prefix}_cnt c ON {on_c}""",
        f"{prefix}_marg": f"""SELECT *, sum(n) OVER (PARTITION BY {byp}{a}) AS ra,
                                     sum(n) OVER (PARTITION BY {byp}{b}) AS rb
                              FROM {prefix}_conf""",
        f"{prefix}_po": f"""SELECT {byp}CAST(sum(n) AS BIGINT) AS n,
                                 CAST(sum(CASE WHEN {a} = {b} THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS po,
                                 CAST(sum(CASE WHEN {a} = {b} THEN CAST(ra AS DOUBLE) * rb ELSE 0 END) AS DOUBLE)
                                   / (CAST(sum(n) AS DOUBLE) * sum(n)) AS pe
                            FROM {prefix}_marg {'GROUP BY ' + grp if grp else ''}""",
        f"{prefix}_kappa": f"""SELECT {byp}n, po, pe,
                                    CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END AS kappa
                               FROM {prefix}_po""",
    }


def r6(x: str) -> str:
    return f"round({x}, 6)"
