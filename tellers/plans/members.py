"""Members: lists, search, headers, and their voting statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.plans.lookups import members_who_voted
from tellers.plans.search import MEMBER_FIELDS, search
from tellers.plans.tables import Tables, with_vote_type
from tellers.operators.sizing import splittable_join

SEARCH_ROWS = 50  # fixed value: length of the search answer unless the caller says otherwise


def _with_party(members: DataFrame, tables: Tables) -> DataFrame:
    names = tables.lookup("party", party_id="id", party_name="name")
    return members.join(names, "party_id", "left").select(
        "id", "first_name", "last_name", "party_abbr", "party_name"
    )


_NAME_ORDER = ("party_abbr", "last_name", "first_name", "id")


def voting_members(tables: Tables) -> DataFrame:
    """Members who have voted, by party and name."""
    return _with_party(members_who_voted(tables), tables).orderBy(*_NAME_ORDER)


def member_search(
    tables: Tables, text: str, rows: int | None = SEARCH_ROWS, index: DataFrame | None = None
) -> DataFrame:
    """The first ``rows`` members who have voted and whose name or party holds the text.

    ``rows=None`` gives all of them. With an ``index`` of the members only those that may
    hold the text are read.
    """
    needle = text.strip()
    if not needle:
        return voting_members(tables)
    holding = search(tables["member"], needle, MEMBER_FIELDS, index)
    members = members_who_voted(tables.replaced(member=holding))
    first = members if rows is None else members.orderBy(*_NAME_ORDER).limit(rows)
    return _with_party(first, tables).orderBy(*_NAME_ORDER)


def member_header(tables: Tables, member_id: int | None = None) -> DataFrame:
    """One member, or all, with the party's name; no vote needed."""
    members = tables["member"]
    if member_id is not None:
        members = members.where(F.col("id") == member_id)
    return _with_party(members, tables)


def member_stats(tables: Tables, member_id: int | None = None) -> DataFrame:
    """Count per vote type, of one member or of all."""
    votes = tables["vote"]
    if member_id is not None:
        votes = votes.where(F.col("member_id") == member_id)
    counts = votes.groupBy("member_id", "vote_type_id").agg(F.expr("count(1) AS votes"))
    named = with_vote_type(counts, tables).select("member_id", "vote_type", "vote_type_id", "votes")
    return named if member_id is None else named.orderBy("vote_type_id")


def member_stats_by_id(tables: Tables, member_id: int | None = None) -> DataFrame:
    """The same with the vote type's id first, in its order."""
    counts = member_stats(tables, member_id).selectExpr(
        "member_id", "vote_type_id AS id", "vote_type AS type", "votes"
    )
    return counts if member_id is None else counts.orderBy("id")


def ballot_topic_ids(tables: Tables) -> DataFrame:
    """(ballot_id, topic_ids) of the ballots whose bill has a topic."""
    by_bill = (
        tables["bill_topic"].where("bill_id IS NOT NULL")
        .groupBy("bill_id").agg(F.expr("collect_set(topic_id) AS topic_ids"))
    )
    ballots = tables["ballot"].selectExpr("id AS ballot_id", "bill_id")
    return splittable_join(ballots, by_bill, ["bill_id"], "inner").select("ballot_id", "topic_ids")


def member_topic_stats(tables: Tables, member_id: int | None = None) -> DataFrame:
    """Count per topic and vote type; a vote counts in each topic of its bill.

    Topics are put on the ballots, not on the votes: votes are shuffled once, by
    ballot, with a short array joined to them, and are counted per topic on the
    map side of the only shuffle after that.
    """
    votes = tables["vote"].select("ballot_id", "member_id", "vote_type_id")
    if member_id is not None:
        votes = votes.where(F.col("member_id") == member_id)
    counts = (
        votes.join(ballot_topic_ids(tables), "ballot_id")
        .selectExpr("member_id", "vote_type_id", "explode(topic_ids) AS topic_id")
        .groupBy("member_id", "topic_id", "vote_type_id")
        .agg(F.expr("count(1) AS votes"))
    )
    topics = tables.lookup("topic", topic_id="id", topic="name")
    named = with_vote_type(counts.join(topics, "topic_id"), tables).select(
        "member_id", "topic_id", "topic", "vote_type_id", "vote_type", "votes"
    )
    return named if member_id is None else named.orderBy("topic", "vote_type_id")
