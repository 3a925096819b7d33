"""Joins of a long, possibly skewed side with a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "_key_hash"


def lookup_left(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``keyed``, which has one row per key.

    Any number of ``rows`` may share a key. Adaptive execution splits such a hot
    partition while it joins, but only if both inputs come straight from a shuffle made
    for the join. ``keyed`` is usually the result of an aggregation that is partitioned
    by the same key already and would be joined in place, unsplittable. Joining on the
    key and its hash asks for that shuffle on both sides; ``keyed`` is the short side.
    A ``keyed`` table below the broadcast threshold needs no shuffle at all.
    """
    left = rows.withColumn(_SPREAD, F.xxhash64(key))
    right = keyed.withColumn(_SPREAD, F.xxhash64(key))
    return left.join(right, [key, _SPREAD], "left").drop(_SPREAD)
