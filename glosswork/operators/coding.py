"""Theme coding: text, labeller, normalised themes, and resuming an interrupted job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.fixed_values import CODEBOOK
from glosswork.functions.text import (
    is_empty_review, parsed_answer, prompt, review_text, theme_columns,
)
from glosswork.operators.calls import Ask, Caller, CallLimits
from glosswork.operators.features import add_missing_columns


#: Title and review as they are, without the layout of the text.
SEARCHED = ("_title", "_review")


class TextLabeller(Protocol):
    """Adds ``response`` (STRING, null where the call failed) to rows with ``row_key``, ``text``,
    ``prompt`` and the two fields of the text by themselves (``SEARCHED``). A labeller that calls a service belongs in ``mapInPandas``, one client per task."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def recorded_labeller(answers: DataFrame, key: str = "row_key") -> TextLabeller:
    """Answers recorded earlier, joined by key."""
    return lambda rows: rows.join(answers.select(key, "response"), key, "left")


def codebook_labeller(flags: Callable[[Column, Column], Mapping[str, Column]]) -> TextLabeller:
    """Answers found by searching title and review, without the layout around them, and their lower-case
    form; stays inside the JVM."""
    def label(rows: DataFrame) -> DataFrame:
        lowered = rows.withColumn("_plain", F.concat_ws("\n", *SEARCHED)).withColumn("_lowered", F.lower("_plain"))
        found = [c.alias(n) for n, c in flags(F.col("_plain"), F.col("_lowered")).items()]
        return lowered.withColumn("response", F.to_json(F.struct(*found))).drop("_plain", "_lowered")
    return label


def function_labeller(connect: Callable[[], Ask], limits: CallLimits = CallLimits()) -> TextLabeller:
    """Answers from a Python function or coroutine function of the prompt, such as a client of a model service.

    ``connect`` runs once per task and returns the function, which is called within ``limits``. A row
    whose calls all failed has a null answer and the last reason in ``error_text``; the other rows are
    not affected.
    """
    def label(rows: DataFrame) -> DataFrame:
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with Caller(connect(), limits) as caller:
                for batch in batches:
                    answers = caller.answers(batch["prompt"])
                    yield batch.assign(response=[a for a, _ in answers], error_text=[e for _, e in answers])

        return rows.mapInPandas(run, ", ".join([*kept, "response string", "error_text string"]))
    return label


def labelling_input(df: DataFrame, title: str = "title", review: str = "review_text",
                    codebook: Mapping[str, str] = CODEBOOK, max_chars: int | None = None) -> DataFrame:
    """Adds ``text``, ``prompt`` and the plain fields; a column the table does not have counts as missing.
    With ``max_chars`` text and fields are cut."""
    missing = F.lit(None).cast("string")
    part = lambda n: F.col(f"`{n}`").cast("string") if n in df.columns else missing
    cut = lambda c: c if max_chars is None else F.substring(c, 1, max_chars)
    with_text = df.withColumns({"text": review_text(part(title), part(review), max_chars),
                                **{n: cut(part(c)) for n, c in zip(SEARCHED, (title, review))}})
    return with_text.withColumn("prompt", prompt(F.col("text"), codebook))


def normalise_answers(answered: DataFrame, themes: Sequence[str]) -> DataFrame:
    """Adds ``status`` and one 0/1 column per theme to rows with a ``response``.

    ``error`` rows got no answer and ``bad_json`` rows an unreadable one: both are coded 0, but can be
    told apart and retried.
    """
    read = answered.withColumn("_parsed", parsed_answer(F.col("response")))
    status = (F.when(F.col("response").isNull(), "error").when(F.col("_parsed").isNull(), "bad_json").otherwise("ok"))
    return read.withColumns({"status": status, **theme_columns(F.col("_parsed"), themes)}).drop("_parsed")


def code_themes(df: DataFrame, labeller: TextLabeller, themes: Sequence[str],
                key: str = "row_key", **text_options) -> DataFrame:
    """``(row_key, status, themes…)`` for every row, and ``error_text`` where the labeller gives it.

    Rows without a text are ``empty`` and coded 0; the labeller never sees them. Emptiness is decided
    below whatever join the labeller makes, so a labeller that needs no text does not move texts.
    """
    rows = labelling_input(df, **text_options).select(key, "text", "prompt", *SEARCHED)
    empty = is_empty_review(F.col("text"))
    coded = normalise_answers(labeller(rows.where(~empty)), themes)
    reasons = [c for c in ("error_text",) if c in coded.columns]
    blank = rows.where(empty).select(key, F.lit("empty").alias("status"), *[F.lit(0).alias(t) for t in themes],
                                     *[F.lit(None).cast("string").alias(c) for c in reasons])
    return coded.select(key, "status", *themes, *reasons).unionByName(blank)


def write_back(df: DataFrame, coded: DataFrame, themes: Sequence[str], key: str = "row_key") -> DataFrame:
    """Coded themes put into their columns; rows not coded yet keep what they had."""
    base = add_missing_columns(df, themes)
    fresh = coded.select(key, *[F.col(t).alias(f"_{t}") for t in themes])
    joined = base.join(fresh, key, "left")
    return joined.withColumns({t: F.coalesce(F.col(f"_{t}"), F.col(t)) for t in themes}).drop(
        *[f"_{t}" for t in themes])


def pending_rows(df: DataFrame, done: DataFrame, key: str = "row_key",
                 retry: Sequence[str] = ()) -> DataFrame:
    """Rows without a result. The result table is the only record of progress; rows whose status is
    in ``retry`` count as not done."""
    finished = done.where(~F.col("status").isin(*retry)) if retry else done
    return df.join(finished.select(key), key, "left_anti")
