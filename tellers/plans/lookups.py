"""Short lists: topics, ballot types, parties that have voted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tellers.plans.tables import Tables


def topics(tables: Tables) -> DataFrame:
    """All topics by name."""
    return tables["topic"].select("id", "name").orderBy("name")


def ballot_types(tables: Tables) -> DataFrame:
    """All ballot types by id."""
    return tables["ballot_type"].select("id", "type").orderBy("id")


def members_who_voted(tables: Tables) -> DataFrame:
    """Members with at least one vote.

    The distinct keys are made on the map side, so the vote table is reduced to
    one row per member before anything is shuffled.
    """
    voted = tables["vote"].selectExpr("member_id AS id").distinct()
    return tables["member"].join(voted, "id", "left_semi")


def voting_parties(tables: Tables) -> DataFrame:
    """Distinct (abbreviation, name) of the parties whose members have voted."""
    parties = tables.lookup("party", party_id="id", name="name")
    return (
        members_who_voted(tables)
        .where("party_abbr IS NOT NULL")
        .join(parties, "party_id")
        .selectExpr("party_abbr AS abbreviation", "name")
        .distinct()
        .orderBy("abbreviation", "name")
    )
