"""Counts of members' votes that are kept and changed, not made again from all votes.

Two tables of signed rows: votes by member, bill and vote type, and votes by member,
topic and vote type. New votes add rows to both; a label that comes or goes adds rows
with the sign of the change to the second, made from the bill's rows in the first. The
sum over a key is its count, so changes may come in any order and need not be merged
before they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.sizing import splittable_join
from tellers.plans.tables import Tables, with_vote_type

BY_BILL = ("member_id", "bill_id", "vote_type_id")
BY_TOPIC = ("member_id", "topic_id", "vote_type_id")


def summed(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key, without those that have come to nothing."""
    return changes.groupBy(*keys).agg(F.sum("votes").alias("votes")).where("votes <> 0")


def _labels(bill_topic: DataFrame) -> DataFrame:
    return bill_topic.where("bill_id IS NOT NULL").select("bill_id", "topic_id").distinct()


def bill_changes(votes: DataFrame, ballots: DataFrame) -> DataFrame:
    """What votes add to the counts by bill; ``bill_id`` is NULL for ballots without one, or unknown."""
    bills = ballots.select(F.col("id").alias("ballot_id"), "bill_id")
    joined = splittable_join(votes.select("ballot_id", "member_id", "vote_type_id"), bills, ["ballot_id"], "left")
    return joined.groupBy(*BY_BILL).agg(F.count(F.lit(1)).alias("votes"))


def topic_changes(by_bill: DataFrame, labels: DataFrame) -> DataFrame:
    """What counts by bill add to the counts by topic under given labels."""
    joined = splittable_join(by_bill.where("bill_id IS NOT NULL"), _labels(labels), ["bill_id"], "inner")
    return joined.groupBy(*BY_TOPIC).agg(F.sum("votes").alias("votes"))


def relabelled(by_bill: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of the counts by topic when labels change: only bills that differ are counted."""
    old = _labels(before).withColumn("sign", F.lit(-1))
    signed = old.unionByName(_labels(after).withColumn("sign", F.lit(1)))
    changed = signed.groupBy("bill_id", "topic_id").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    joined = splittable_join(by_bill.where("bill_id IS NOT NULL"), changed, ["bill_id"], "inner")
    return joined.groupBy(*BY_TOPIC).agg(F.sum(F.col("votes") * F.col("sign")).alias("votes"))


def kept_member_stats(tables: Tables, by_bill: DataFrame, member_id: int | None = None) -> DataFrame:
    """Count per vote type, of one member or of all, from the kept counts."""
    rows = by_bill if member_id is None else by_bill.where(F.col("member_id") == member_id)
    counts = summed(rows, ("member_id", "vote_type_id"))
    named = with_vote_type(counts, tables).select("member_id", "vote_type", "vote_type_id", "votes")
    return named if member_id is None else named.orderBy("vote_type_id")


def kept_member_topic_stats(tables: Tables, by_topic: DataFrame, member_id: int | None = None) -> DataFrame:
    """Count per topic and vote type, of one member or of all, from the kept counts."""
    rows = by_topic if member_id is None else by_topic.where(F.col("member_id") == member_id)
    topics = tables.lookup("topic", topic_id="id", topic="name")
    named = with_vote_type(summed(rows, BY_TOPIC).join(topics, "topic_id"), tables).select(
        "member_id", "topic_id", "topic", "vote_type_id", "vote_type", "votes"
    )
    return named if member_id is None else named.orderBy("topic", "vote_type_id")
