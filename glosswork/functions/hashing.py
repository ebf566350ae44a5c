"""Repeatable draws taken from a hash of the row key.

A draw depends only on (key, salt), so a split or a bootstrap weight is the same however the data
is partitioned, after a task retry, and in any other engine that knows md5. The comparisons are
done on the hexadecimal text itself: no number conversion, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.fixed_values import POISSON_CUTS, SEED, TEST_SHARE

_SPAN = 2 ** 32


def key_hash(key: str | Column, salt: object = SEED) -> Column:
    """32 hexadecimal digits drawn from the key and a salt."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))


def hex_threshold(share: float) -> str:
    """First 8 hexadecimal digits below which a hash falls with probability ``share``."""
    return format(int(share * _SPAN), "08x")


def is_test(key: str | Column, share: float = TEST_SHARE, seed: object = SEED) -> Column:
    return key_hash(key, seed) < F.lit(hex_threshold(share))


def split_label(key: str | Column, share: float = TEST_SHARE, seed: object = SEED) -> Column:
    return F.when(is_test(key, share, seed), F.lit("test")).otherwise(F.lit("train"))


def uniform(key: str | Column, salt: object) -> Column:
    """Uniform number in [0, 1) with 32 random bits."""
    return F.conv(F.substring(key_hash(key, salt), 1, 8), 16, 10).cast("bigint") / F.lit(float(_SPAN))


def poisson_weight(key: str | Column, salt: object) -> Column:
    """Bootstrap weight: how often the row is drawn, Poisson(1), for one ensemble member.

    Written as a sum of comparisons rather than CASE: every term is always evaluated, so code
    generation computes the hash once.
    """
    digits = F.substring(key_hash(key, salt), 1, 8)
    weight = F.lit(0)
    for cut in POISSON_CUTS:
        weight = weight + (digits >= F.lit(format(math.ceil(cut * _SPAN), "08x"))).cast("int")
    return weight
