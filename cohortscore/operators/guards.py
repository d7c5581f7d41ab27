"""Joins that fail where a side repeats a key, in the pass that joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _once(rows: DataFrame, keys: Sequence[str], side: str, with_null: bool) -> DataFrame:
    """`rows` (those of null keys only if asked), failing where a key comes twice when they are computed: grouped by the key, as the join deals them anyway."""
    rest = [c for c in rows.columns if c not in keys]
    value = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    grouped = rows.filter(known).groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("_r"))
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"the {side} side repeats a key")).cast("boolean")).otherwise(F.lit(True))
    single = grouped.filter(guard).select(*keys, *[F.col(f"_r.`{c}`") for c in rest])
    return single.unionByName(rows.filter(~known).select(*single.columns)) if with_null else single


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", unique: str = "right") -> DataFrame:
    """A join whose `unique` side (left, right, both or neither) has no key twice, or it fails when it runs.

    The guard is part of the same pass: a side is grouped by the keys that it is joined by, so no job and no shuffle is
    added. A null key matches nothing and is no repetition. Columns of the right side beside the keys have names of
    their own. For inner, left, left_semi and left_anti joins.
    """
    if unique in ("left", "both"):
        left = _once(left, keys, "left", how in ("left", "left_anti"))
    if unique in ("right", "both"):
        right = _once(right, keys, "right", False)
    return left.join(right, list(keys), how)
