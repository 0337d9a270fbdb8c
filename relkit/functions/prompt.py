"""Prompt construction for the automatic judge.

Everything is a native column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the judge's reply formats and placeholders).
RESPONSES_GRADED = {"Irrelevant (0)": 0, "Relevant (1)": 1, "Highly Relevant (2)": 2}
RESPONSES_BINARY = {"Irrelevant (0)": 0, "Relevant (1)": 1}
TOPIC_SLOT, TABLE_SLOT = "$TOPIC", "$TABLE"
FIELD_TEXT_SLOT, FIELD_NAME_SLOT = "$FIELD_TEXT", "$FIELD_NAME"
USER_PATTERN = "Topic: '$TOPIC'\nTable: ```\n$TABLE\n```\nRelevant?"
CONTEXT_LIMIT = 16385        # tokens; a prompt at or above it is cut
CUT_MARGIN = 15              # tokens kept = limit - margin (- system tokens)
SHRINK_STEP = 200            # characters dropped per retry attempt
MAX_ATTEMPTS = 7

# a token: a run of letters/digits, or one other non-space character
TOKEN_PIECE = r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\t\n\x0B\f\r ]"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _json_str(x: Column) -> Column:
    esc = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, F.lit('"'), F.lit('\\"'))
    esc = F.replace(esc, F.lit("\n"), F.lit("\\n"))
    esc = F.replace(esc, F.lit("\r"), F.lit("\\r"))
    esc = F.replace(esc, F.lit("\t"), F.lit("\\t"))
    esc = F.replace(esc, F.lit("\b"), F.lit("\\b"))
    esc = F.replace(esc, F.lit("\f"), F.lit("\\f"))
    esc = F.when(esc.rlike(r"[^\x20-\x7E]"), F.array_join(F.transform(F.split(esc, ""), _escaped), "")).otherwise(esc)
    return F.when(x.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def _escaped(ch: Column) -> Column:
    """One character; outside printable ASCII as \\uXXXX, above U+FFFF as two."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    code = F.ascii(ch)
    over = code - 0x10000
    pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00))
    return F.when(code.between(32, 126), ch).when(code > 0xFFFF, pair).otherwise(unit(code))


def table_json(rel: Column | str) -> Column:
    """F9 (native): the relation as Python's ``json.dumps`` text (", "
    separators) with every backslash doubled, as the prompt embeds it.
    Control and non-ASCII characters are escaped as \\uXXXX.  A relation without
    nulls and characters to escape needs no work a cell: its lists are joined."""
    r = _c(rel)
    flat = F.flatten(r)
    plain = ~F.array_join(flat, "").rlike(r"[^ !#-\[\]-~]") & (F.size(flat) == F.size(F.array_compact(flat)))

    def dumped(column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(r, column), ", "), F.lit("]"))

    joined = dumped(lambda c: F.when(F.size(c) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]'))))
    escaped = F.replace(dumped(lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, _json_str), ", "), F.lit("]"))),
                        F.lit("\\"), F.lit("\\\\"))
    return F.when(F.coalesce(plain, F.lit(False)), joined).otherwise(escaped)


def render(template: Column | str, **slots: Column) -> Column:
    """literal placeholder substitution in the given order (never a
    regex replacement, so '$1' or '\\d' in the data stay as they are)."""
    out = F.lit(template) if isinstance(template, str) else template
    for slot, value in slots.items():
        out = F.replace(out, F.lit(slot), F.coalesce(value, F.lit("")))
    return out


def render_table_prompt(query: Column, rel_json: Column, template: str = USER_PATTERN) -> Column:
    return render(template, **{TOPIC_SLOT: query, TABLE_SLOT: rel_json})


def token_pieces(text: Column | str) -> Column:
    """Tokens with their leading whitespace, so that joining a prefix of the
    pieces reproduces the original text prefix exactly."""
    return F.regexp_extract_all(_c(text), F.lit(r"\s*(?:" + TOKEN_PIECE + ")"), 0)


def token_count(text: Column | str) -> Column:
    """token counter (word runs + single symbols), the unit of ``budget_cut``."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN_PIECE), 0)).cast("long")


def budget_cut(prompt: Column | str, system_tokens: Column | int = 0,
               limit: int = CONTEXT_LIMIT, margin: int = CUT_MARGIN) -> Column:
    """when prompt + system tokens reach ``limit`` keep the first
    ``limit - margin - system_tokens`` tokens of the prompt."""
    p = _c(prompt)
    sys_t = F.lit(system_tokens) if isinstance(system_tokens, int) else system_tokens
    pieces = token_pieces(p)
    keep = F.greatest(F.lit(limit - margin) - sys_t, F.lit(0)).cast("int")
    return F.when(F.size(pieces) + sys_t >= limit, F.array_join(F.slice(pieces, 1, keep), "")).otherwise(p)


def shrink(prompt: Column | str, attempt: Column | int, step: int = SHRINK_STEP) -> Column:
    """attempt a >= 1 drops the last step·a characters."""
    p = _c(prompt)
    a = F.lit(attempt) if isinstance(attempt, int) else attempt
    keep = F.greatest(F.length(p) - a * step, F.lit(0))
    return F.when(a >= 1, F.substring(p, F.lit(1), keep)).otherwise(p)


def parse_rating(response: Column | str, graded: bool = True) -> Column:
    """exact reply text → label; anything else (trailing space, case,
    empty, null) → null."""
    r = _c(response)
    table = RESPONSES_GRADED if graded else RESPONSES_BINARY
    out = None
    for text, lab in table.items():
        out = (F.when(r == text, F.lit(lab)) if out is None else out.when(r == text, F.lit(lab)))
    return out
