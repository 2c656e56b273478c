"""Joins whose cost does not depend on how the keys are distributed.

A shuffle join sends all rows of one key to one task, so a key that holds a third of a table
makes one task do a third of the work. ``skew_join`` takes such hot keys out of the shuffle:
they are matched by a broadcast, everything else is shuffled. A key is hot when it has more
than ``HOT_ROWS`` rows, so there are at most ``rows / HOT_ROWS`` of them: at 10**12 rows, a
hundred thousand keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.session import stored

HOT_ROWS = 10_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Does the optimizer's size estimate stay within the session's broadcast threshold?"""
    # the threshold is -1 when broadcasts are switched off, and then nothing fits
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def key_groups(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Rows per key as ``n``. Partial aggregation runs before the shuffle, so a hot key costs
    one row per task; null keys form a group like any other."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates)


def in_order(joined: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` in their order, then what the join added: a join by name puts its
    keys first, and the order must not depend on which join was chosen."""
    return joined.select(*rows.columns, *[name for name in joined.columns if name not in rows.columns])


def by_id(rows: DataFrame, artifacts: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join by ids of which both sides hold about one each, such as plans with their evaluations.

    Both sides grow with the plans, so neither is broadcast: the optimizer sizes a stored table by its compressed
    files, which for repeating ids and texts is a small part of what the driver would have to hold."""
    return rows.join(artifacts.hint("merge"), keys if isinstance(keys, str) else list(keys), how)


def _join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return in_order(rows.join(lookup, list(keys), how), rows)
    # null-safe equality needs an expression, so the right keys are renamed and dropped
    renamed = lookup.select(
        *[F.col(key).alias(f"__{key}") for key in keys],
        *[name for name in lookup.columns if name not in keys],
    )
    matched = rows.join(
        renamed,
        reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys]),
        how,
    )
    return matched.drop(*[f"__{key}" for key in keys])


def skew_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str,
    *,
    null_safe: bool = False,
    sizes: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` (any size, any skew) with ``lookup`` (at most one row per key).

    ``how`` is inner, left, left_semi or left_anti. ``sizes`` is a frame of keys and ``n`` when
    the caller has already counted the rows per key; otherwise they are counted here, by a job of
    their own: unless it finds a hot key, nulls included, the join is a plain one. So ``rows`` stands
    once in the plan, and the plans of joins upon joins do not grow by a factor with each.

    With hot keys the hot part and the shuffled part scan ``rows`` once each. Where counted ``sizes`` hold no hot key,
    the broadcast of hot keys is empty and adaptive execution drops the hot part unread.
    """
    if fits_broadcast(lookup):
        return _join(rows, lookup, keys, how, null_safe)
    counted = sizes
    if counted is None:
        counted = stored(key_groups(rows, keys).filter(F.col("n") > hot_rows), "hot_keys")
        if counted.isEmpty():
            return _join(rows, lookup, keys, how, null_safe)
    if not null_safe and how in ("left", "left_anti"):
        # a null key meets nothing: its rows pass by the join instead of gathering in one task
        present = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
        met = skew_join(rows.filter(present), lookup, keys, how, null_safe=True, sizes=counted, hot_rows=hot_rows)
        return met.unionByName(rows.filter(~present), allowMissingColumns=True)
    hot = counted.filter(F.col("n") > hot_rows).select(*keys)
    hot_lookup = _join(lookup, F.broadcast(hot), keys, "left_semi", null_safe)
    hot_part = _join(
        _join(rows, F.broadcast(hot), keys, "left_semi", null_safe),
        F.broadcast(hot_lookup), keys, how, null_safe,
    )
    cold_part = _join(
        _join(rows, F.broadcast(hot), keys, "left_anti", null_safe), lookup, keys, how, null_safe
    )
    return in_order(hot_part.unionByName(cold_part), rows)
