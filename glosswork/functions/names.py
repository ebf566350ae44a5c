"""Feature names: the derived-feature rule, display names, and which feature a rule text is about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.fixed_values import DERIVED_PREFIX, DERIVED_SUFFIXES


def is_derived_name(name: str) -> bool:
    """Plan-time form, for column lists."""
    return name.startswith(DERIVED_PREFIX) or name.endswith(DERIVED_SUFFIXES)


def is_theme_name(name: str) -> bool:
    return name.startswith("T") and "_" in name


def is_derived(c: Column) -> Column:
    """Row form, for tables of names."""
    rule = c.startswith(DERIVED_PREFIX)
    for suffix in DERIVED_SUFFIXES:
        rule = rule | c.endswith(suffix)
    return rule


def prefix_display(c: Column) -> Column:
    """Derived features always carry the prefix; other names stay."""
    return F.when(is_derived(c) & ~c.startswith(DERIVED_PREFIX), F.concat(F.lit(DERIVED_PREFIX), c)).otherwise(c)


def clean_display(c: Column, derived: Column) -> Column:
    """Readable name: no prefix inside, blanks for underscores, ``llm `` in front of derived ones."""
    bare = F.when(derived, F.replace(c, F.lit(DERIVED_PREFIX), F.lit(""))).otherwise(c)
    spaced = F.trim(F.regexp_replace(F.replace(bare, F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.when(derived, F.concat(F.lit("llm "), spaced)).otherwise(spaced)


def rule_feature(rule: Column, actual: Sequence[str], shown: Sequence[str]) -> Column:
    """The feature a rule text mentions, or the text itself.

    Every name a feature goes by is a needle; upper and lower case are alike. The first needle found, in the order of rank
    (display names, then raw ones), length (longest first) and place in the list, names the feature. The names are a short
    list known when the plan is built, so this is one COALESCE: no join with a condition, and nothing to broadcast.
    """
    needles = sorted((rank, -len(needle), place, needle.lower(), names[1])
                     for place, names in enumerate(zip(shown, actual)) for rank, needle in enumerate(names))
    lowered = F.lower(rule)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(needle)), F.lit(feature)) for *_, needle, feature in needles], rule)
