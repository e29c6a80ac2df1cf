"""Keyed writes as DataFrame algebra: last wins, first wins, ignore existing.

Keeping one row per key is a rank filter that Spark turns into a group limit on
both sides of the shuffle: every map task sends at most one row of a key, so a
hot key never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.operators.sizing import splittable_join


def _first_per_key(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the greatest ``order`` per key."""
    return _first_per_key(df, keys, [F.desc(c) for c in order])


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the least ``order`` per key."""
    return _first_per_key(df, keys, [F.asc(c) for c in order])


def last_arrived(df: DataFrame, keys: Sequence[str] = ("id",), arrival: str = "arrival") -> DataFrame:
    """Of rows that repeat a key the one that arrived last.

    ``arrival`` is a column of ``df`` that ``read_pages`` makes; without it the
    greatest values of all other columns stand in, so that the answer is the same on
    every run.
    """
    order = [arrival] if arrival in df.columns else []
    order += [c for c in df.columns if c not in keys and c != arrival]
    return latest(df, keys, order)


def without_keys(df: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken``, distinct keys; NULL keys are kept."""
    return splittable_join(df, taken, keys, "left_anti")


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``target`` with the batch's rows put in; a key conflict replaces the whole row.

    Only the batch is reduced by key, once; the target is filtered against the keys
    of what is left of it.
    """
    last = latest(batch, keys, order)
    return without_keys(target, last.select(*keys), keys).unionByName(last.select(*target.columns))


def new_rows(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The batch's first row of every key that ``target`` does not hold."""
    first = earliest(batch, keys, order).select(*target.columns)
    return without_keys(first, target.select(*keys), keys)


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``target`` with the batch's new keys appended; a key conflict keeps the old row."""
    return target.unionByName(new_rows(target, batch, keys, order))
