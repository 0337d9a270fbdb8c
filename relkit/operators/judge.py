"""Automatic judging (G1-G6): a pluggable batch judge behind ``mapInPandas`` --
the only step that leaves the JVM, because the judge itself is an external call.

A judge is any picklable callable ``judge(prompts, systems, attempts) -> replies``
over lists, called once a batch.  What it said is kept as a table of attempts
``(keys..., attempt, reply, error)``; labels and retries are decided from that
table with DataFrame operations, so a job that is interrupted goes on where its
stored attempts end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relkit.functions.prompt import (FIELD_NAME_SLOT, FIELD_TEXT_SLOT, MAX_ATTEMPTS, SHRINK_STEP, parse_rating, render,
                                     shrink)
from relkit.session import cut_lineage

Judge = Callable[[list, list, list], list]


def replies(df: DataFrame, judge_fn: Judge, keys: Sequence[str], prompt: str = "prompt",
            system: str | None = None, attempt: str | None = None) -> DataFrame:
    """(keys..., attempt, reply, error): one call a batch; where it fails, its
    rows have no reply and the reason.  Only keys and texts cross into Python."""
    inp = df.select(*keys, F.col(prompt).alias("_prompt"),
                    (F.col(system) if system else F.lit(None)).cast("string").alias("_system"),
                    (F.col(attempt) if attempt else F.lit(0)).cast("int").alias("attempt"))
    kept = [*keys, "attempt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields if f.name in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[kept].copy()
            try:
                out["reply"] = judge_fn(b["_prompt"].tolist(), b["_system"].tolist(), b["attempt"].tolist())
                out["error"] = None
            except Exception as e:  # an unavailable judge marks the rows
                out["reply"], out["error"] = None, f"{type(e).__name__}: {e}"
            yield out

    return inp.mapInPandas(run, f"{schema}, reply string, error string")


def judge(df: DataFrame, judge_fn: Judge, keys: Sequence[str], prompt: str = "prompt",
          system: str | None = None, graded: bool = True, annotator: str = "llm",
          on_error: str = "keep") -> DataFrame:
    """One reply per row, (keys..., response, label, annotator, error);
    unparsable replies and failed calls keep the row with a null label and a
    reason (``on_error='drop'`` drops them, as the scripts without retry do)."""
    out = replies(df, judge_fn, keys, prompt, system).select(
        *keys, F.col("reply").alias("response"), parse_rating("reply", graded).alias("label"),
        F.lit(annotator).alias("annotator"), "error")
    out = out.withColumn("error", F.coalesce("error", F.when(F.col("label").isNull(), "unparsable")))
    return out.where(F.col("label").isNotNull()) if on_error == "drop" else out


def resolve_attempts(attempts: DataFrame, keys: Sequence[str], graded: bool = False, annotator: str = "llm",
                     max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """G2 over a table of attempts: (keys..., label, attempts, annotator).

    The first attempt with a parsable reply decides; later ones, and those from
    ``max_attempts`` on, count for nothing.  Without one the label is 0 and the
    annotator 'error' once all attempts are used (the rows of the error sink),
    and both are null while some are left.  Of several replies to one attempt the
    smallest label counts.  One aggregation, partial before its shuffle."""
    a = attempts.where(F.col("attempt").between(0, max_attempts - 1))
    a = a.withColumn("_label", parse_rating("reply", graded))
    first = F.min(F.when(F.col("_label").isNotNull(), F.struct("attempt", F.col("_label").alias("label"))))
    g = a.groupBy(*keys).agg(first.alias("_first"), F.max("attempt").alias("_last"))
    used = F.coalesce(F.col("_first.attempt"), F.col("_last")) + 1
    failed = F.col("_last") == max_attempts - 1
    return g.select(*keys, F.coalesce(F.col("_first.label"), F.when(failed, 0)).alias("label"), used.alias("attempts"),
                    F.when(F.col("_first").isNotNull(), annotator).when(failed, "error").alias("annotator"))


def open_attempts(prompts: DataFrame, attempts: DataFrame, keys: Sequence[str], prompt: str = "prompt",
                  graded: bool = False, max_attempts: int = MAX_ATTEMPTS, step: int = SHRINK_STEP) -> DataFrame:
    """``prompts`` that still need a call, with the number of their next attempt
    and the prompt shortened for it (``step`` characters an attempt)."""
    so_far = resolve_attempts(attempts, keys, graded, max_attempts=max_attempts)
    left = prompts.join(so_far.select(*keys, "label", "attempts"), list(keys), "left").where(F.col("label").isNull())
    number = F.coalesce("attempts", F.lit(0))
    return left.withColumn("attempt", number).withColumn(prompt, shrink(prompt, number, step)).drop("label", "attempts")


def judge_with_retry(df: DataFrame, judge_fn: Judge, keys: Sequence[str], prompt: str = "prompt",
                     system: str | None = None, graded: bool = False, annotator: str = "llm",
                     max_attempts: int = MAX_ATTEMPTS, step: int = SHRINK_STEP) -> DataFrame:
    """Up to ``max_attempts`` rounds; each sends the prompts that are still
    open, and its replies are checkpointed before the next, so no call is made
    again.  The result is ``resolve_attempts`` of all rounds."""
    attempts = cut_lineage(replies(df, judge_fn, keys, prompt, system))
    for _ in range(1, max_attempts):
        left = open_attempts(df, attempts, keys, prompt, graded, max_attempts, step)
        new = cut_lineage(replies(left, judge_fn, keys, prompt, system, "attempt"))
        if new.isEmpty():
            break
        attempts = attempts.unionByName(new)
    return resolve_attempts(attempts, keys, graded, annotator, max_attempts)


def replay_judge(df: DataFrame, recorded: DataFrame, keys: Sequence[str],
                 label: str = "label", annotator: str = "replay") -> DataFrame:
    """Judge by replaying recorded labels (a join, no Python)."""
    return (df.select(*keys).join(recorded.select(*keys, F.col(label).alias("label")), list(keys), "left")
            .withColumn("annotator", F.lit(annotator)))


def unpivot_field_prompts(df: DataFrame, keys: Sequence[str], fields: dict[str, str],
                          template: Column | str) -> DataFrame:
    """One prompt per (key, field): ``fields`` maps the name a prompt shows to
    the column holding its text; $FIELD_TEXT / $FIELD_NAME are filled literally."""
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.col(col).cast("string").alias("field_text"))
                        for name, col in fields.items()])
    template = F.lit(template) if isinstance(template, str) else template
    long = df.select(*keys, template.alias("_template"), F.inline(entries))
    out = long.withColumn("prompt", render(F.col("_template"), **{
        FIELD_TEXT_SLOT: F.col("field_text"), FIELD_NAME_SLOT: F.col("field")}))
    return out.drop("_template")
