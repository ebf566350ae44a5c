"""Turning text, flags and odd numbers into DOUBLE columns without ever raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.fixed_values import FALSE_WORDS, NULL_TOKENS, TRUE_WORDS

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
EDGE_SPACE = rf"^{SPACE}+|{SPACE}+$"
NUMBER = rf"^{SPACE}*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?{SPACE}*$"
INFINITE = rf"(?i)^{SPACE}*[+-]?inf(inity)?{SPACE}*$"
NOT_NUMBER_TEXT = "target column {0} holds a value that is not a number"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (SQL ``trim`` removes blanks only)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def clear_null_tokens(c: Column) -> Column:
    """Null for the usual spellings of a missing value in CSV text."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _one_of(words: tuple[str, ...]) -> str:
    return rf"(?i)^{SPACE}*({'|'.join(words)}){SPACE}*$"


def word_flag(c: Column) -> Column:
    """1/0 for yes/no words, null for every other text.

    Matched from the start of the text, so a long text is dismissed at its first characters."""
    return F.when(c.rlike(_one_of(TRUE_WORDS)), 1.0).when(c.rlike(_one_of(FALSE_WORDS)), 0.0)


def text_to_number(c: Column) -> Column:
    """Number written in the text, else null. Plain decimal and exponent forms and infinities only."""
    return (
        F.when(c.rlike(NUMBER), strip(c).try_cast("double"))
        .when(c.rlike(INFINITE),
              F.when(F.contains(c, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def to_number(c: Column, dtype: T.DataType, on_error: str = "null", name: str = "") -> Column:
    """``c`` of the given type as DOUBLE; missing stays null and NaN becomes null.

    ``on_error='raise'`` stops the job at the first text that is neither a number nor missing.
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    value = text_to_number(c)
    if on_error == "raise":
        bad = c.isNotNull() & value.isNull() & ~c.isin(*NULL_TOKENS)
        value = F.when(bad, F.raise_error(F.lit(NOT_NUMBER_TEXT.format(name))).cast("double")).otherwise(value)
    return value
