"""Grouping by 128-bit digests of wide keys.

A key with text in it can be as long as a document, and grouping by it moves every text through
the shuffle. Rows are grouped by a digest of the key instead; only keys whose digest occurs twice
are looked at as they are, to tell equal keys from keys that only share a digest.

Up to two columns of fixed width are mapped one to one (XXH64 of one 64-bit value is a
bijection), so their digests need no second look.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.operators.joins import key_groups, skew_join
from rowwarden.session import stored

DIGEST = ("key_nulls", "key_d0", "key_d1")
FIXED_WIDTH = frozenset({
    "boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz"})


def is_exact(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Is the digest of these columns one to one?"""
    return len(keys) <= 2 and all(rows.schema[key].dataType.typeName() in FIXED_WIDTH for key in keys)


def hash_pair(keys: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a wide key; the leading tag makes the second a different one."""
    return [F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)]


def digest_columns(keys: Sequence[str], exact: bool) -> list[Column]:
    """``DIGEST`` of a key: which parts are null, and two longs. Hashes pass over nulls, so the first
    column keeps keys apart that differ only in where their nulls are."""
    nulls = F.lit(0)
    for position, key in enumerate(keys):
        nulls = nulls + F.when(F.col(key).isNull(), 1 << position).otherwise(0)
    pair = [F.xxhash64(key) for key in keys] if exact else hash_pair(keys)
    pair += [F.lit(0).cast("long")] * (2 - len(pair))
    return [value.alias(name) for value, name in zip((nulls, *pair), DIGEST, strict=True)]


def exact_groups(rows: DataFrame, keys: Sequence[str], groups: DataFrame, *aggregates: Column) -> tuple[DataFrame, DataFrame | None]:
    """The keys as they are behind the digests in ``groups``: (``DIGEST``, *keys, n, *aggregates), and the
    digests that several keys share, None if there are none. ``rows`` carries ``DIGEST`` and the keys."""
    met = skew_join(rows, groups.select(*DIGEST), DIGEST, "left_semi", sizes=groups)
    found = stored(key_groups(met, [*DIGEST, *keys], *aggregates), "keys")
    shared = found.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(*DIGEST)
    return found, None if shared.isEmpty() else stored(shared, "collided")


def grouped_rows(rows: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], hot_rows: int) -> DataFrame:
    """``rows`` whose key (nulls are equal) occurs more than once, with ``aggregates`` of its group.

    The rows are joined to their groups by digest. Of colliding digests, which are hardly ever any, the keys
    themselves decide."""
    named = [value.alias(name) for name, value in aggregates.items()]
    exact = is_exact(rows, keys)
    tagged = rows.select("*", *digest_columns(keys, exact))
    groups = key_groups(tagged, DIGEST, *named).filter("n > 1")
    if exact:
        joined = skew_join(tagged, groups.drop("n"), DIGEST, "inner", sizes=groups, hot_rows=hot_rows)
        return joined.select(*rows.columns, *aggregates)
    groups = stored(groups, "groups")
    found, shared = exact_groups(tagged, keys, groups, *named)
    clear = groups if shared is None else groups.join(shared, list(DIGEST), "left_anti")
    joined = skew_join(tagged, clear.drop("n"), DIGEST, "inner", sizes=clear, hot_rows=hot_rows).select(*rows.columns, *aggregates)
    if shared is None:
        return joined
    rest = skew_join(tagged, shared, DIGEST, "left_semi", sizes=groups)
    many = found.join(shared, list(DIGEST), "left_semi").filter("n > 1")
    again = skew_join(rest, many.select(*keys, *aggregates), list(keys), "inner", null_safe=True, sizes=many, hot_rows=hot_rows)
    return joined.unionByName(again.select(*rows.columns, *aggregates))
