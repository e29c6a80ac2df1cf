"""Repairs: parties from biographies, bill numbers; and samples to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.functions.biography import party_of
from tellers.functions.text import first_filled
from tellers.operators.keyed import earliest, last_arrived
from tellers.operators.numbering import number_rows
from tellers.operators.sizing import splittable_join
from tellers.plans.tables import Tables


def member_parties(actors: DataFrame, arrival: str = "id") -> DataFrame:
    """(id, short, full, arrival) of every actor, from the biography."""
    parsed = actors.select("id", party_of(F.col("biografi")).alias("_p"), F.col(arrival).alias("arrival"))
    return parsed.select("id", "_p.short", "_p.full", "arrival")


def _named(parsed: DataFrame) -> DataFrame:
    """Rows with a short name; the full name falls back to it."""
    short = first_filled(F.col("short"))
    return parsed.where(short.isNotNull()).withColumn("name", first_filled(F.col("full"), short))


def party_codes(parsed: DataFrame) -> DataFrame:
    """Distinct short names, sorted."""
    return _named(parsed).select("short").distinct().orderBy("short")


def parties_seen(parsed: DataFrame) -> DataFrame:
    """(abbreviation, name, arrival): per short name the first actor's party name."""
    seen = _named(parsed).select(F.col("short").alias("abbreviation"), "name", "arrival")
    return earliest(seen, ["abbreviation"], ["arrival"])


def add_parties(parties: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parties`` with the (abbreviation, name) pairs it lacks.

    New ids go on from the greatest, in the order of arrival.
    """
    pair = ["abbreviation", "name"]
    known = parties.select(*pair)
    new = splittable_join(parties_seen(parsed), known, pair, "left_anti")
    top = parties.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    numbered = number_rows(new, "arrival", "_n").select(
        (top + F.col("_n")).cast("long").alias("id"), *pair
    )
    return parties.select("id", *pair).unionByName(numbered)


def repair_members(members: DataFrame, parsed: DataFrame, parties: DataFrame) -> DataFrame:
    """Members with the party of their biography, where it names one.

    Of an actor that comes twice the last biography counts. A party matches on (short,
    full) first, else on the short name alone, the lowest id each. The party is looked up per distinct (short, full), so a party
    that most members share is looked up once.
    """
    once = last_arrived(parsed.select("id", "short", "full", "arrival"))
    named = _named(once).select("id", F.col("short").alias("abbreviation"), "name")
    pairs = parties.groupBy("abbreviation", "name").agg(F.min("id").alias("_by_pair"))
    shorts = parties.groupBy("abbreviation").agg(F.min("id").alias("_by_short"))
    found = (
        named.select("abbreviation", "name").distinct()
        .join(pairs, ["abbreviation", "name"], "left")
        .join(shorts, "abbreviation", "left")
        .select("abbreviation", "name", F.coalesce("_by_pair", "_by_short").alias("_party_id"))
    )
    matched = splittable_join(
        named, found, ["abbreviation", "name"], "left"
    ).select("id", F.col("abbreviation").alias("_short"), "_party_id")
    hit = F.col("_short").isNotNull()
    return members.join(matched, "id", "left").select(
        "id", "first_name", "last_name",
        F.when(hit, F.col("_short")).otherwise(F.col("party_abbr")).alias("party_abbr"),
        F.when(hit, F.col("_party_id")).otherwise(F.col("party_id")).alias("party_id"),
    )


def _last_numbers(records: DataFrame) -> DataFrame:
    columns = ["id", "nummer", *(["arrival"] if "arrival" in records.columns else [])]
    return last_arrived(records.select(*columns))


def repair_numbers(bills: DataFrame, records: DataFrame) -> DataFrame:
    """Bills with the number of the last fetched record, also where that is NULL."""
    fetched = _last_numbers(records).select("id", F.col("nummer").alias("_number"), F.lit(True).alias("_hit"))
    number = F.when(F.col("_hit"), F.col("_number")).otherwise(F.col("number"))
    return (
        bills.join(fetched, "id", "left")
        .withColumn("number", number)
        .select(*bills.columns)
    )


def numbered_bills(bills: DataFrame, records: DataFrame) -> DataFrame:
    """How many bills the repair gave a number, out of how many."""
    fetched = _last_numbers(records).select("id", first_filled(F.col("nummer")).alias("_number"))
    return bills.select("id").join(fetched, "id", "left").agg(
        F.count("_number").alias("numbered"), F.count(F.lit(1)).alias("bills")
    )


def sample_members(tables: Tables, rows: int = 10, seed: int | None = None) -> DataFrame:
    """Random members with a party; a top-k over random keys, not a full sort.

    With a ``seed`` the keys are hashes of it and the id, so the sample is the same
    on every run and in any engine.
    """
    names = tables.lookup("party", party_id="id", party_name="name")
    chosen = (
        tables["member"].where(F.col("party_abbr").isNotNull())
        .orderBy(F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")))).limit(rows)
    )
    return chosen.join(names, "party_id", "left").select(
        "first_name", "last_name", "party_abbr", "party_name"
    )


def sample_bills(bills: DataFrame, rows: int = 5) -> DataFrame:
    """The first bills, by id, that have a number."""
    numbered = bills.where(F.col("number").isNotNull()).select("id", "number", "short_title")
    return numbered.orderBy("id").limit(rows)
