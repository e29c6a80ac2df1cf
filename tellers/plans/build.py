"""Raw feed records into domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellers.functions.text import first_filled, strip
from tellers.operators.keyed import last_arrived, latest
from tellers.operators.sizing import splittable_join
from tellers.schema import ACTOR_GROUP, ACTOR_PERSON, PERIOD_START
from tellers.sources.landed import restrict_to_ids


def build_lookup(records: DataFrame) -> DataFrame:
    """Ballot types and vote types: two columns as they come, the last of each id."""
    return last_arrived(records).select("id", "type")


def build_parties(actors: DataFrame) -> DataFrame:
    """Groups as parties; the id stands in for an abbreviation, the name parts for a name."""
    def part(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    name = first_filled(F.col("navn"), F.concat(part("fornavn"), F.lit(" "), part("efternavn")))
    return actors.where(F.col("typeid") == ACTOR_GROUP).select(
        "id",
        first_filled(F.col("gruppenavnkort"), F.col("id").cast("string")).alias("abbreviation"),
        strip(name).alias("name"),
    )


def build_members(actors: DataFrame, arrival: str | None = None) -> DataFrame:
    """Persons as members; of groups that share an abbreviation the last to arrive counts.

    ``arrival`` names the column to go by: by default ``arrival`` where the records
    have one, else the id.
    """
    arrival = arrival or ("arrival" if "arrival" in actors.columns else "id")
    groups = actors.where(
        (F.col("typeid") == ACTOR_GROUP) & (first_filled(F.col("gruppenavnkort")).isNotNull())
    )
    by_abbreviation = latest(
        groups.select(
            F.col("gruppenavnkort").alias("party_abbr"), F.col("id").alias("party_id"),
            F.col(arrival).alias("_arrival"),
        ),
        ["party_abbr"], ["_arrival"],
    ).drop("_arrival")
    members = actors.where(F.col("typeid") == ACTOR_PERSON).select(
        "id",
        F.coalesce("fornavn", F.lit("")).alias("first_name"),
        F.coalesce("efternavn", F.lit("")).alias("last_name"),
        F.col("gruppenavnkort").alias("party_abbr"),
    )
    return splittable_join(members, by_abbreviation, ["party_abbr"], "left").select(
        "id", "first_name", "last_name", "party_abbr", "party_id"
    )


def steps_in_period(steps: DataFrame, start: str = PERIOD_START) -> DataFrame:
    """Case steps dated on or after the start of the period, by date text."""
    return steps.where(
        first_filled(F.col("dato")).isNotNull() & (F.substring("dato", 1, 10) >= start)
    )


def ballots_in_period(ballots: DataFrame, steps: DataFrame, start: str = PERIOD_START) -> DataFrame:
    """Raw ballots with a step in the period, joined to that step.

    Of a ballot or a step that comes twice the last one counts.
    """
    linked = last_arrived(ballots).where(F.coalesce("sagstrinid", F.lit(0)) != 0)
    kept = steps_in_period(last_arrived(steps), start).select(
        F.col("id").alias("sagstrinid"), "dato", F.col("sagid").alias("bill_id")
    )
    return linked.join(kept, "sagstrinid")


def build_ballots(ballots: DataFrame, steps: DataFrame, start: str = PERIOD_START) -> DataFrame:
    """Ballots of the period; the step gives date and bill.

    The update date is the fallback for the step's date. It never applies, since
    the period asks for a date, and is kept for callers with other step filters.
    """
    held = first_filled(F.col("dato"), F.col("opdateringsdato"))
    return ballots_in_period(ballots, steps, start).select(
        "id",
        F.col("nummer").alias("number"),
        F.col("konklusion").alias("conclusion"),
        F.coalesce(F.col("vedtaget").cast("boolean"), F.lit(False)).alias("passed"),
        F.col("kommentar").alias("comment"),
        held.try_cast("timestamp_ntz").alias("held_at"),
        F.col("typeid").alias("type_id"),
        "bill_id",
    )


def build_bills(bills: DataFrame, ballots: DataFrame) -> DataFrame:
    """Bills that a kept ballot is about; of one that comes twice the last record."""
    wanted = ballots.where(F.coalesce("bill_id", F.lit(0)) != 0).select("bill_id")
    return last_arrived(restrict_to_ids(bills, wanted)).select(
        "id",
        F.col("titel").alias("title"),
        F.col("titelkort").alias("short_title"),
        "resume",
        F.col("nummer").alias("number"),
        F.col("typeid").alias("type_id"),
        F.col("periodeid").alias("period_id"),
    )


def build_votes(records: DataFrame) -> DataFrame:
    """Votes as they come, with their arrival where the records have one."""
    return records.select(
        "id",
        F.col("afstemningid").alias("ballot_id"),
        F.col("aktørid").alias("member_id"),
        F.col("typeid").alias("vote_type_id"),
        *(["arrival"] if "arrival" in records.columns else []),
    )
