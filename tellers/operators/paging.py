"""Sorted pages, pages after a key, and page totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellers.session import cut

BOUNDS = 63  # values that divide a list into ranges
SAMPLED = 1024  # rows they are chosen from
ROWS_AT_ONCE = 100_000  # rows of a range that is sorted without being divided again


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 50

    def __post_init__(self) -> None:
        if self.number < 1 or self.size < 1:
            raise ValueError("page number and size start at 1")

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def take_page(df: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """One page of ``df``; a top-k per task, not a full sort."""
    return df.orderBy(*order).offset(page.offset).limit(page.size)


def after_key(order: Sequence[tuple[str, str]], last: Sequence[object]) -> Column:
    """Rows that come after ``last`` in ``order``, a list of (column, "asc" | "desc").

    For pages far down a list: the filter reaches the scan, where an offset would
    sort and drop all rows before it. NULL sorts first ascending, last descending.
    """
    after = F.lit(False)
    for (name, direction), value in reversed(list(zip(order, last, strict=True))):
        column, bound = F.col(name), F.lit(value)
        same = column.isNull() if value is None else F.coalesce(column == bound, F.lit(False))
        if direction == "asc":
            beyond = column.isNotNull() if value is None else F.coalesce(column > bound, F.lit(False))
        elif value is None:
            beyond = F.lit(False)
        else:
            beyond = column.isNull() | (column < bound)
        after = beyond | (same & after)
    return after


def _sort_columns(order: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]


def rows_around(
    rows: DataFrame, order: Sequence[tuple[str, str]], offset: int, size: int, rows_at_once: int = ROWS_AT_ONCE
) -> tuple[DataFrame, int]:
    """The part of ``rows`` that holds some places of their order, and where its first row stands.

    A sample's values divide the rows into ranges, whose rows are counted in one pass on
    the map side. The ranges of the wanted places are divided again until they have few
    enough rows. ``rows`` should be a written table, and the last order column unique.
    """
    begin = 0
    while True:
        sample = rows.orderBy(F.xxhash64(*[F.col(c) for c, _ in order]), *_sort_columns(order)).limit(SAMPLED)
        drawn = sample.select(*[c for c, _ in order]).orderBy(*_sort_columns(order)).collect()
        step = max(1, -(-len(drawn) // (BOUNDS + 1)))
        bounds = [tuple(r) for r in drawn[step - 1::step]][:BOUNDS]
        number = sum((after_key(order, b).cast("int") for b in bounds), F.lit(0))
        counted = {r["range"]: r["n"] for r in rows.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
        total, chosen, before = sum(counted.values()), [], 0
        for r in range(len(bounds) + 1):
            n = counted.get(r, 0)
            if before + n > offset - begin and before < offset - begin + size:
                chosen.append((r, before))
            before += n
        if not chosen:
            return rows.limit(0), begin
        first, last = chosen[0][0], chosen[-1][0]
        inside = sum(counted.get(r, 0) for r in range(first, last + 1))
        if first > 0:
            rows = rows.where(after_key(order, bounds[first - 1]))
        if last < len(bounds):
            rows = rows.where(~after_key(order, bounds[last]))
        begin += chosen[0][1]
        if inside <= rows_at_once or inside == total:
            return rows, begin


def far_page(
    rows: DataFrame, order: Sequence[tuple[str, str]], page: Page, rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """One page of a written table, by its number, however far down: only its range is sorted."""
    part, begin = rows_around(rows, order, page.offset, page.size, rows_at_once)
    return part.orderBy(*_sort_columns(order)).offset(page.offset - begin).limit(page.size)


def ranked_page(df: DataFrame, order: Sequence[tuple[str, str]], page: Page, far: bool = False) -> DataFrame:
    """One page as a written table: a top-k per task, or with ``far`` by counts of ranges."""
    if far:
        return cut(far_page(cut(df), order, page))
    return cut(take_page(df, _sort_columns(order), page))


def page_info(df: DataFrame, page: Page, by: Sequence[str] = ()) -> DataFrame:
    """Total and page count of ``df``, over all or per ``by`` columns."""
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total"))
        .select(
            *by,
            "total",
            F.lit(page.number).alias("page"),
            F.lit(page.size).alias("per_page"),
            F.expr(f"(total + {page.size - 1}) div {page.size}").alias("pages"),
        )
    )
