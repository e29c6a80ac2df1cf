"""Row counts and constraint checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.bitmaps import ids_among
from tellers.operators.sizing import splittable_join
from tellers.plans.tables import Tables
from tellers.schema import CONSTRAINTS

SUMMARY_TABLES = (
    "ballot_type", "vote_type", "party", "member", "bill", "topic", "ballot", "vote",
)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: Tables, names: Iterable[str] = SUMMARY_TABLES) -> DataFrame:
    """(table, rows) of the main tables."""
    return _union(
        tables[name].selectExpr(f"'{name}' AS table", "count(1) AS rows")
        for name in names
    )


def _report(counted: DataFrame, table: str, rule: str) -> DataFrame:
    return counted.selectExpr(
        f"'{table}' AS table", f"'{rule}' AS rule", "CAST(coalesce(violations, 0) AS BIGINT) AS violations"
    )


def repeated_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once; keys with a NULL do not count as equal."""
    whole = df.select(*key).na.drop("any")
    return whole.groupBy(*key).agg(F.expr("count(1) AS rows")).where("rows > 1")


def _row_rules(df: DataFrame, name: str, tables: Tables) -> DataFrame | None:
    """Counts of all rules of a table that hold row by row, in one pass over it.

    Each referenced table is joined as its distinct keys, so no row multiplies, and a
    value that most rows hold is split between tasks.
    """
    rules = CONSTRAINTS[name]
    if not rules.required and not rules.references:
        return None
    counts = {f"required {c}": f"count_if(`{c}` IS NULL)" for c in rules.required}
    rows = df.select(*dict.fromkeys([*rules.required, *[c for c, _ in rules.references]]))
    for n, (column, target) in enumerate(rules.references):
        keys = tables[target].selectExpr(f"id AS {column}").where(f"{column} IS NOT NULL").distinct()
        rows = splittable_join(rows, keys.selectExpr("*", f"true AS _found_{n}"), [column], "left")
        counts[f"reference {column} to {target}"] = f"count_if(`{column}` IS NOT NULL AND _found_{n} IS NULL)"
    counted = rows.selectExpr(*[f"{count} AS `{rule}`" for rule, count in counts.items()])
    long = counted.unpivot([], list(counts), "rule", "violations")
    return long.selectExpr(f"'{name}' AS table", "rule", "violations")


def append_report(
    name: str, new: DataFrame, stored_ids: DataFrame, known: Mapping[str, DataFrame]
) -> DataFrame:
    """(table, rule, violations) that new rows would bring to a table that has none.

    ``stored_ids`` has the stored ids as bitmaps, ``known`` those of the referenced
    tables by name, as ``id_bitmaps`` makes them, so neither the stored rows nor the
    referenced ones are read. With rules on whole-number ids the answer is exact, as a
    full report of the stored and the new rows together would be.
    """
    rules = CONSTRAINTS[name]
    parts = []
    for key in rules.unique:
        if key != ("id",):
            counted = repeated_keys(new, key).selectExpr("count(1) AS violations")
        else:
            twice = repeated_keys(new, key).select("id")
            counted = twice.unionByName(ids_among(new.select("id"), stored_ids)).distinct().selectExpr("count(1) AS violations")
        parts.append(_report(counted, name, f"unique {', '.join(key)}"))
    if rules.required:
        counts = new.agg(*[F.count_if(F.col(c).isNull()).alias(f"required {c}") for c in rules.required])
        long = counts.unpivot([], counts.columns, "rule", "violations")
        parts.append(long.selectExpr(f"'{name}' AS table", "rule", "violations"))
    for column, target in rules.references:
        asked = new.select(F.col(column).alias("id")).where("id IS NOT NULL")
        held = splittable_join(asked, ids_among(asked, known[target]), ["id"], "left_anti")
        parts.append(_report(held.selectExpr("count(1) AS violations"), name, f"reference {column} to {target}"))
    return _union(parts)


def constraint_report(tables: Tables, names: Iterable[str]) -> DataFrame:
    """(table, rule, violations) for the keys, set columns and references of tables.

    A unique rule counts keys, the others count rows. A table is read once for all
    its set columns and references, and once for each unique key, whose shuffle holds
    the key alone.
    """
    parts = []
    for name in names:
        df = tables[name]
        for key in CONSTRAINTS[name].unique:
            counted = repeated_keys(df, key).selectExpr("count(1) AS violations")
            parts.append(_report(counted, name, f"unique {', '.join(key)}"))
        by_row = _row_rules(df, name, tables)
        if by_row is not None:
            parts.append(by_row)
    return _union(parts)
