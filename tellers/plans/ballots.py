"""The ballot list: filters, sort, pages, totals; and the ballot header."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellers.operators.paging import Page, after_key, page_info, ranked_page
from tellers.plans.search import BILL_FIELDS, search
from tellers.plans.tables import Tables, bill_columns, with_ballot_type, with_bill
from tellers.session import cut

# Sort keys and the columns they stand for; "title" sorts by the short title.
SORTS = {
    "date": "held_at",
    "bill_number": "bill_number",
    "title": "short_title",
    "passed": "passed",
    "type": "type_id",
}
_BILL_SORTS = {"bill_number", "short_title"}


@dataclass(frozen=True)
class BallotFilter:
    """Filters of the ballot list; those left out do not apply.

    Dates are ISO text. ``date_to`` takes in the whole of its day; with
    ``whole_day=False`` the bound is the instant itself, which leaves out the
    ballots of the day when only a date is given.
    """

    topic_id: int | None = None
    type_id: int | None = None
    passed: bool | None = None
    text: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    whole_day: bool = True

    @property
    def needle(self) -> str:
        return (self.text or "").strip()


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def ballot_conditions(f: BallotFilter) -> list[Column]:
    """The predicates on the ballot's own columns."""
    conditions = []
    if f.type_id is not None:
        conditions.append(F.col("type_id") == f.type_id)
    if f.passed is not None:
        conditions.append(F.col("passed") == f.passed)
    if f.date_from:
        conditions.append(F.col("held_at") >= _instant(f.date_from))
    if f.date_to and f.whole_day and len(f.date_to) == 10:
        next_day = F.lit(f.date_to).cast("date") + F.expr("INTERVAL 1 DAY")
        conditions.append(F.col("held_at") < next_day.cast("timestamp_ntz"))
    elif f.date_to and len(f.date_to) == 10:
        # Compared as text a moment is greater than its own day, midnight too.
        conditions.append(F.col("held_at") < _instant(f.date_to))
    elif f.date_to:
        conditions.append(F.col("held_at") <= _instant(f.date_to))
    return conditions


def on_topic(ballots: DataFrame, tables: Tables, topic_id: int | None) -> DataFrame:
    """Ballots whose bill is in the topic; no topic, no filter."""
    if topic_id is None:
        return ballots
    bills = tables["bill_topic"].where(F.col("topic_id") == topic_id).select("bill_id")
    return ballots.join(bills, "bill_id", "left_semi")


def filtered_ballots(tables: Tables, f: BallotFilter, index: DataFrame | None = None) -> DataFrame:
    """Ballots that pass the filter, one row each, without any bill column.

    With an ``index`` of the bills, as ``search.gram_index`` makes, the text is looked
    for in the bills that may hold it, else in all.
    """
    ballots = tables["ballot"]
    for condition in ballot_conditions(f):
        ballots = ballots.where(condition)
    ballots = on_topic(ballots, tables, f.topic_id)
    if f.needle:
        bills = search(tables["bill"], f.needle, BILL_FIELDS, index).select(F.col("id").alias("bill_id"))
        ballots = ballots.join(bills, "bill_id", "left_semi")
    return ballots


def list_order(sort: str | None, direction: str | None) -> list[tuple[str, str]]:
    """(column, direction) pairs; unknown values fall back to newest first."""
    column = SORTS.get(sort or "", "held_at")
    return [(column, direction if direction in ("asc", "desc") else "desc"), ("id", "asc")]


def order_columns(order: list[tuple[str, str]]) -> list[Column]:
    return [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]


def _listed(ballots: DataFrame, tables: Tables) -> DataFrame:
    rows = ballots.select("id", "number", "passed", "held_at", "type_id", "bill_id")
    return with_ballot_type(with_bill(rows, tables, ", "), tables).select(
        "id", "number", "passed", "held_at", "type_id", "ballot_type", "bill_id", "bill_number",
        "title", "short_title", "period_id", "topics",
    )


def narrowed(tables: Tables, rows: DataFrame) -> Tables:
    """The tables with bills and bill topics cut down to the bills of ``rows``.

    For a page or one ballot, written before: Spark knows the size of its file, so
    a page of usual length turns this into a scan against few keys.
    """
    wanted = rows.select("bill_id").distinct()
    own = tables["bill"].join(wanted.withColumnRenamed("bill_id", "id"), "id", "left_semi")
    topics = tables["bill_topic"].join(wanted, "bill_id", "left_semi")
    return tables.replaced(bill=own, bill_topic=topics)


def ballot_list(tables: Tables, f: BallotFilter = BallotFilter(), index: DataFrame | None = None) -> DataFrame:
    """Every ballot that passes the filter with bill, type and topics, unsorted."""
    return _listed(filtered_ballots(tables, f, index), tables)


def ballots_sorted(
    tables: Tables, f: BallotFilter = BallotFilter(), sort: str | None = None,
    direction: str | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """The whole list in order: a range-partitioned sort."""
    return ballot_list(tables, f, index).orderBy(*order_columns(list_order(sort, direction)))


def ballot_page(
    tables: Tables, f: BallotFilter = BallotFilter(), page: Page = Page(),
    sort: str | None = None, direction: str | None = None,
    after: tuple[object, int] | None = None, index: DataFrame | None = None, far: bool = False,
) -> DataFrame:
    """One page of the list; ``after`` (sort value, id) instead of an offset.

    ``far`` finds a page far down by counting ranges of the order, so that only the
    page's own range is sorted.

    Page first, enrich after: the top-k runs on the narrow filtered rows, is
    settled once, and only its bills are looked up. The bill is joined before
    only where the sort needs it.
    """
    order = list_order(sort, direction)
    rows = filtered_ballots(tables, f, index).select(
        "id", "number", "passed", "held_at", "type_id", "bill_id"
    )
    if order[0][0] in _BILL_SORTS:
        keys = bill_columns(tables).select("bill_id", order[0][0])
        rows = rows.join(keys, "bill_id", "left")
    if after is not None:
        rows = rows.where(after_key(order, after))
        page = Page(1, page.size)
    rows = ranked_page(rows, order, page, far)
    return _listed(rows, narrowed(tables, rows)).orderBy(*order_columns(order))


def ballot_page_info(
    tables: Tables, f: BallotFilter = BallotFilter(), page: Page = Page(), index: DataFrame | None = None
) -> DataFrame:
    """Total and pages, counted on the filtered ballots before topics multiply them."""
    return page_info(filtered_ballots(tables, f, index), page)


def ballot_header(tables: Tables, ballot_id: int | None = None) -> DataFrame:
    """The head of one ballot's document, or of every ballot's."""
    ballots = tables["ballot"]
    if ballot_id is not None:
        ballots = cut(ballots.where(F.col("id") == ballot_id))
        tables = narrowed(tables, ballots)
    return with_ballot_type(with_bill(ballots, tables, ",", "resume"), tables).select(
        "id", "number", "passed", "conclusion", "comment", "held_at", "type_id", "ballot_type",
        "bill_id", "bill_number", "title", "short_title", "resume", "period_id", "topics",
    )
