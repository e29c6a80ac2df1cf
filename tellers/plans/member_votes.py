"""The vote list of a member, newest first, or of all members."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.paging import Page, page_info, ranked_page
from tellers.plans.ballots import BallotFilter, ballot_conditions, narrowed, on_topic
from tellers.plans.search import search
from tellers.plans.tables import (
    Tables, with_ballot_type, with_bill, with_vote_type,
)


@dataclass(frozen=True)
class VoteFilter:
    """Filters of the vote list; those left out do not apply."""

    topic_id: int | None = None
    type_id: int | None = None
    passed: bool | None = None
    text: str | None = None
    vote_type_id: int | None = None


_TITLES = {"title": "title", "short_title": "short_title"}


def _ballots(tables: Tables, f: VoteFilter, index: DataFrame | None = None) -> DataFrame:
    ballots = tables["ballot"]
    for condition in ballot_conditions(BallotFilter(type_id=f.type_id, passed=f.passed)):
        ballots = ballots.where(condition)
    ballots = on_topic(ballots, tables, f.topic_id)
    needle = (f.text or "").strip()
    if needle:
        bills = search(tables["bill"], needle, _TITLES, index).select(F.col("id").alias("bill_id"))
        ballots = ballots.join(bills, "bill_id", "left_semi")
    return ballots.withColumnRenamed("id", "ballot_id")


def _votes(tables: Tables, f: VoteFilter, member_id: int | None) -> DataFrame:
    votes = tables["vote"].withColumnRenamed("id", "vote_id")
    if member_id is not None:
        votes = votes.where(F.col("member_id") == member_id)
    if f.vote_type_id is not None:
        votes = votes.where(F.col("vote_type_id") == f.vote_type_id)
    return votes


_BALLOT = ("ballot_id", "held_at", "passed", "type_id", "bill_id")
_LISTED = (
    "member_id", "vote_id", "ballot_id", "held_at", "passed", "type_id", "ballot_type",
    "bill_number", "title", "short_title", "vote_type", "vote_type_id", "topics",
)


def _enriched(ballots: DataFrame, tables: Tables) -> DataFrame:
    return with_ballot_type(with_bill(ballots, tables, ","), tables)


def member_votes(
    tables: Tables, f: VoteFilter = VoteFilter(), member_id: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Every vote that passes the filter, unsorted; ``index`` as for the ballot list.

    Ballots are enriched before they meet the votes, which are shuffled once.
    """
    ballots = _enriched(_ballots(tables, f, index).select(*_BALLOT), tables)
    votes = _votes(tables, f, member_id).join(ballots, "ballot_id")
    return with_vote_type(votes, tables, "left").select(*_LISTED)


def member_votes_page(
    tables: Tables, f: VoteFilter = VoteFilter(), member_id: int | None = None, page: Page = Page(), far: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """One page of the list, newest first; only the page's rows are enriched.

    ``far`` finds a page far down by counting ranges of the order.
    """
    order = [F.col("held_at").desc(), F.col("vote_id").asc()]
    rows = _votes(tables, f, member_id).join(_ballots(tables, f, index).select(*_BALLOT), "ballot_id")
    rows = ranked_page(rows, [("held_at", "desc"), ("vote_id", "asc")], page, far)
    here = narrowed(tables, rows)
    return with_vote_type(_enriched(rows, here), here, "left").select(*_LISTED).orderBy(*order)


def member_votes_page_info(
    tables: Tables, f: VoteFilter = VoteFilter(), member_id: int | None = None, page: Page = Page(),
    index: DataFrame | None = None,
) -> DataFrame:
    """Total and pages per member, counted without bill, type and topic joins."""
    ballots = _ballots(tables, f, index).select("ballot_id")
    votes = _votes(tables, f, member_id).select("ballot_id", "member_id")
    return page_info(votes.join(ballots, "ballot_id"), page, by=["member_id"])
