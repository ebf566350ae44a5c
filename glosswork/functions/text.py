"""Review text, labelling prompt, and reading the labeller's answer."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.fixed_values import CODEBOOK, EMPTY_REVIEW_TEXTS, PROMPT_INTRO
from glosswork.functions.coerce import strip

INTEGER_TEXT = r"^[+-]?\d+(_\d+)*$"


def review_text(title: Column, review: Column, max_chars: int | None = None) -> Column:
    """``Title: … | Review: …`` with missing parts empty, trimmed; with ``max_chars``
    it is then cut to so many characters."""
    text = strip(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")),
                          F.lit(" | Review: "), F.coalesce(review, F.lit(""))))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def is_empty_review(text: Column) -> Column:
    return text.isin(*EMPTY_REVIEW_TEXTS)


def prompt_header(codebook: Mapping[str, str] = CODEBOOK) -> str:
    """Everything before the review text; built once per job, not per row."""
    book = json.dumps(dict(codebook), indent=2)
    return "\n\n".join([PROMPT_INTRO, f"Codebook:\n{book}", "Review:\n"])


def prompt(text: Column, codebook: Mapping[str, str] = CODEBOOK) -> Column:
    return strip(F.concat(F.lit(prompt_header(codebook)), text))


def json_slice(answer: Column) -> Column:
    """From the first ``{`` to the last ``}``; null where there is no such stretch."""
    start = F.instr(answer, "{")
    back = F.instr(F.reverse(answer), "}")
    end = F.length(answer) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(answer, start, end - start + 1))


def parsed_answer(answer: Column) -> Column:
    """The answer's JSON object as VARIANT; null where it is missing or not valid JSON."""
    return F.try_parse_json(json_slice(answer))


def theme_value(parsed: Column, theme: str) -> Column:
    """0/1 for one theme: 1 for a number whose whole part is 1, for true, and for the text of the
    integer 1; everything else, a missing key included, is 0."""
    path = f"$['{theme}']"
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    number = F.try_variant_get(parsed, path, "double")
    text = strip(F.try_variant_get(parsed, path, "string"))
    is_one = (
        F.when(kind == "BOOLEAN", F.try_variant_get(parsed, path, "boolean"))
        .when(kind == "STRING", text.rlike(INTEGER_TEXT)
              & (F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint") == 1))
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
              (number >= 1) & (number < 2))
    )
    return F.when(F.coalesce(is_one, F.lit(False)), 1).otherwise(0)


def theme_columns(parsed: Column, themes: Sequence[str]) -> dict[str, Column]:
    return {theme: theme_value(parsed, theme) for theme in themes}
