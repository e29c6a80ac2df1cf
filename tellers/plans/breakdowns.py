"""Votes of a ballot: by party, one by one, and in total.

Every query takes one ballot or answers for all of them in one pass, with
``ballot_id`` as a column. Counts are made by id first; names are joined to the
few counted rows. One ballot's answer is sorted, the pass over all is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.plans.tables import Tables, with_vote_type


def _votes(tables: Tables, ballot_id: int | None) -> DataFrame:
    votes = tables["vote"]
    return votes if ballot_id is None else votes.where(F.col("ballot_id") == ballot_id)


def _sorted(df: DataFrame, ballot_id: int | None, *columns: str) -> DataFrame:
    return df if ballot_id is None else df.orderBy(*columns)


def ballot_totals(tables: Tables, ballot_id: int | None = None) -> DataFrame:
    """Count per vote type."""
    counts = _votes(tables, ballot_id).groupBy("ballot_id", "vote_type_id").agg(
        F.expr("count(1) AS votes")
    )
    named = with_vote_type(counts, tables).select("ballot_id", "vote_type_id", "vote_type", "votes")
    return _sorted(named, ballot_id, "vote_type_id")


def ballot_party_votes(tables: Tables, ballot_id: int | None = None) -> DataFrame:
    """Count per party and vote type; members without a party are one group."""
    parties = tables.lookup("member", member_id="id", party="party_abbr")
    counts = (
        _votes(tables, ballot_id)
        .join(parties, "member_id")
        .groupBy("ballot_id", "party", "vote_type_id")
        .agg(F.expr("count(1) AS votes"))
    )
    named = with_vote_type(counts, tables).select(
        "ballot_id", "party", "vote_type_id", "vote_type", "votes"
    )
    return _sorted(named, ballot_id, "party", "vote_type_id")


def named_votes(tables: Tables, ballot_id: int | None = None) -> DataFrame:
    """Votes with their own id and their member's name and party."""
    members = tables.lookup(
        "member", member_id="id", first_name="first_name", last_name="last_name",
        party_abbr="party_abbr",
    )
    votes = _votes(tables, ballot_id).withColumnRenamed("id", "vote_id")
    return with_vote_type(votes.join(members, "member_id"), tables)


def ballot_votes(tables: Tables, ballot_id: int | None = None) -> DataFrame:
    """Every vote with its member's name and party."""
    named = named_votes(tables, ballot_id).select(
        "ballot_id", "member_id", "first_name", "last_name", "party_abbr", "vote_type",
        "vote_type_id",
    )
    return _sorted(named, ballot_id, "party_abbr", "last_name", "member_id")
