"""Nested answers: all there is about a ballot or about a member."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.plans.ballots import ballot_header, narrowed
from tellers.plans.members import member_header, member_stats, member_topic_stats
from tellers.plans.tables import Tables, with_vote_type
from tellers.session import cut

VOTES_PER_PART = 10_000
GATHERED = 10_000  # votes of a ballot that one task holds at once
VOTES_PER_TASK = 200_000


def _nested(df: DataFrame, keys: Sequence[str], name: str, *fields: str) -> DataFrame:
    row = f"struct({', '.join(fields)})"
    return df.groupBy(*keys).agg(F.expr(f"sort_array(collect_list({row})) AS {name}"))


def _or_empty(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)))
    return df


_FIELDS = ("party_abbr", "last_name", "member_id", "first_name", "vote_type", "vote_type_id")
_COUNTED = ("party", "vote_type_id", "vote_type", "votes")
_TYPED = ("vote_type_id", "vote_type", "votes")


def _voters(tables: Tables, ballot_id: int | None) -> DataFrame:
    """Members' names; ``known`` tells them from votes without a member.

    For all ballots they are written first. The size of a file is known before the votes
    are read, so members that fit are broadcast and no vote is shuffled by its member.
    """
    members = tables.lookup("member", id="id", first_name="first_name", last_name="last_name", party_abbr="party_abbr")
    members = members if ballot_id is not None else cut(members)
    return members.withColumnRenamed("id", "member_id").withColumn("known", F.lit(True))


def _votes(tables: Tables, ballot_id: int | None) -> DataFrame:
    votes = tables["vote"].selectExpr("id AS vote_id", "ballot_id", "member_id", "vote_type_id")
    return votes if ballot_id is None else votes.where(F.col("ballot_id") == ballot_id)


def _all_votes(tables: Tables, ballot_id: int | None) -> DataFrame:
    """Votes of a known type with their member's names; ``known`` is NULL without a member."""
    return with_vote_type(_votes(tables, ballot_id).join(_voters(tables, ballot_id), "member_id", "left"), tables)


def _tasks(votes: int) -> int:
    """How many tasks so many votes are dealt to.

    Spark goes by the bytes that are shuffled, and names and lists make a vote many times
    larger after: the tasks of a large table would sort on disk. What is joined to the
    votes is dealt to as many, or Spark would shuffle their lists again.
    """
    return max(8, votes // VOTES_PER_TASK + 1)


def _large_ballots(tables: Tables, ballot_id: int | None, limit: int) -> DataFrame:
    """(ballot_id, n) of the ballots with more than ``limit`` votes.

    There are fewer of them than votes by that factor, so they are written once and
    Spark knows their size.
    """
    counted = _votes(tables, ballot_id).where("ballot_id IS NOT NULL").groupBy("ballot_id").agg(F.count(F.lit(1)).alias("n"))
    return cut(counted.where(F.col("n") > limit))


_TOTALS = """sort_array(transform(
        array_distinct(transform(by_type, t -> struct(t.vote_type_id, t.vote_type))),
        k -> struct(k.vote_type_id, k.vote_type, aggregate(
            filter(by_type, t -> t.vote_type_id = k.vote_type_id), 0L, (n, t) -> n + t.votes) AS votes)))"""
_PARTY_TOTALS = """sort_array(transform(
        array_distinct(transform(by_party, t -> struct(t.party, t.vote_type_id, t.vote_type))),
        k -> struct(k.party, k.vote_type_id, k.vote_type, aggregate(
            filter(by_party, t -> t.party <=> k.party AND t.vote_type_id = k.vote_type_id), 0L, (n, t) -> n + t.votes) AS votes)))"""


def _by_part(dealt: DataFrame) -> DataFrame:
    """Counts and votes of each (ballot, part) of votes that are dealt by ballot, or ballot and part.

    Lists do not shrink on the map side, so the rows are shuffled, or stored in buckets,
    and the lists built after; counting inside the part first leaves a few rows to sum.
    """
    row = f"struct({', '.join(_FIELDS)})"
    counted = dealt.withColumnRenamed("party_abbr", "party").groupBy(
        "ballot_id", "part", "known", "party", "vote_type_id", "vote_type"
    ).agg(
        F.count(F.lit(1)).alias("votes"),
        F.expr(f"collect_list({row.replace('party_abbr', 'party AS party_abbr')}) AS single"),
    )
    return counted.groupBy("ballot_id", "part").agg(
        F.expr(f"sort_array(collect_list(IF(known, struct({', '.join(_COUNTED)}), NULL))) AS party_votes"),
        F.expr(f"collect_list(struct({', '.join(_TYPED)})) AS by_type"),
        F.expr("sort_array(flatten(collect_list(IF(known, single, NULL)))) AS single"),
    ).withColumn("totals", F.expr(_TOTALS))


# of one ballot's votes, sorted by part: its parts with their votes
_SHARES = f"""transform(starts, (s, i) -> struct(
        dealt[s - 1].part AS part,
        transform(filter(slice(dealt, s, coalesce(get(starts, i + 1), size(dealt) + 1) - s), v -> v.known),
            v -> struct({', '.join(f'v.{name} AS {name}' for name in _FIELDS)})) AS votes))"""
_STARTS = "filter(sequence(1, size(dealt)), i -> i = 1 OR dealt[i - 1].part <> get(dealt, i - 2).part)"


def _gathered(tables: Tables, dealt: DataFrame, voters: DataFrame, votes_per_part: int) -> DataFrame:
    """(ballot_id, parts, party_votes, totals, shares) of votes that are dealt by the ballot.

    ``shares`` are the parts that have votes, in order.
    """
    of_ballot = W.partitionBy("ballot_id").orderBy("ballot_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = F.ceil(F.count(F.lit(1)).over(of_ballot) / votes_per_part)
    dealt = dealt.withColumn("parts", parts.cast("long")).withColumn("part", F.expr("pmod(deal, parts) + 1"))
    types = tables.lookup("vote_type", vote_type_id="id", vote_type="type").withColumn("typed", F.lit(True))
    named = dealt.join(voters, "member_id", "left").join(types, "vote_type_id", "left")
    counted = named.groupBy("ballot_id", "parts", "typed", "known", "party_abbr", "vote_type_id", "vote_type").agg(
        F.count(F.lit(1)).alias("votes"), F.expr(f"collect_list(struct(part, known, {', '.join(_FIELDS)})) AS dealt")
    ).withColumnRenamed("party_abbr", "party")
    return counted.groupBy("ballot_id", "parts").agg(
        F.expr(f"sort_array(collect_list(IF(typed AND known, struct({', '.join(_COUNTED)}), NULL))) AS party_votes"),
        F.expr(f"collect_list(IF(typed, struct({', '.join(_TYPED)}), NULL)) AS by_type"),
        F.expr("sort_array(flatten(collect_list(IF(typed, dealt, NULL)))) AS dealt"),
    ).select(
        "ballot_id", "parts", "party_votes", F.expr(_TOTALS).alias("totals"), "dealt",
        F.expr(f"IF(size(dealt) = 0, array(), {_STARTS})").alias("starts"),
    ).withColumn("shares", F.expr(_SHARES)).drop("dealt", "starts")


def _whole(tables: Tables, ballot_id: int | None, large: DataFrame | None, votes_per_part: int) -> DataFrame:
    """The documents of all ballots but the large.

    Ids alone are shuffled, once by the ballot; names come to them where they lie.
    """
    head = ballot_header(tables, ballot_id).withColumnRenamed("id", "ballot_id")
    votes = _votes(tables, ballot_id).where("ballot_id IS NOT NULL")
    if large is not None:
        votes = votes.join(large, "ballot_id", "left_anti")
        head = head.join(large, "ballot_id", "left_anti")
    names = [name for name in head.columns if name != "ballot_id"]
    voters = _voters(tables, ballot_id)
    dealt = votes.selectExpr("ballot_id", "member_id", "vote_type_id", "xxhash64(vote_id) AS deal")
    tasks = _tasks(tables["vote"].count()) if ballot_id is None else 1
    dealt, head = (df.repartition(tasks, "ballot_id") for df in (dealt, head))
    one = F.lit(1).cast("long")
    if votes_per_part >= GATHERED:
        named = with_vote_type(dealt.join(voters, "member_id", "left"), tables)
        shown = head.join(_by_part(named.withColumn("part", one)).drop("part"), "ballot_id", "left")
        return shown.select(
            "ballot_id", one.alias("part"), *names, one.alias("parts"), "party_votes", "totals", F.col("single").alias("votes")
        )
    found = _gathered(tables, dealt, voters, votes_per_part)
    # where an id is stored several times its parts are told as often as joins by the id tell them
    ids = tables["ballot"].selectExpr("id AS ballot_id")
    ids = ids if ballot_id is None else ids.where(F.col("ballot_id") == ballot_id)
    repeated = cut(ids.where("ballot_id IS NOT NULL").groupBy("ballot_id").agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1"))
    head = head.withColumn("place", F.row_number().over(W.partitionBy("ballot_id").orderBy("ballot_id")))
    whole = head.join(found, "ballot_id", "left").join(repeated, "ballot_id", "left").withColumns({
        "parts": F.coalesce("parts", one),
        "copies": F.expr("IF(parts > 1, coalesce(copies, 1), 1)"),
    }).withColumn(
        "shares", F.expr("IF(copies > 1, transform(shares, s -> struct(s.part, sort_array(flatten(array_repeat(s.votes, copies))) AS votes)), shares)")
    )
    others = "IF(place = 1, flatten(array_repeat(filter(shares, s -> s.part > 1), copies)), NULL)"
    first = "array_repeat(struct(1L AS part, get(filter(shares, s -> s.part = 1), 0).votes AS votes), copies * copies)"
    rows = whole.withColumn("share", F.expr(f"explode(IF(shares IS NULL, {first}, concat({first}, coalesce({others}, array()))))"))
    headed = F.col("share.part") == 1
    return rows.select(
        "ballot_id", F.col("share.part").alias("part"), *[F.when(headed, F.col(name)).alias(name) for name in names], "parts",
        F.when(headed, F.col("party_votes")).alias("party_votes"), F.when(headed, F.col("totals")).alias("totals"),
        F.col("share.votes").alias("votes"),
    )


def _spread(tables: Tables, large: DataFrame, votes_per_part: int) -> DataFrame:
    """The documents of the large ballots: each part is gathered apart from the others."""
    ballots = cut(tables["ballot"].join(large.withColumnRenamed("ballot_id", "id"), "id", "left_semi"))
    stored = ballots.selectExpr("id AS ballot_id").join(large, "ballot_id")
    split = cut(stored.select("ballot_id", F.ceil(F.col("n") / votes_per_part).cast("long").alias("parts")))
    voters = _voters(tables, None)
    votes = _votes(tables, None)
    part = F.expr("pmod(xxhash64(vote_id), parts) + 1")
    ids = votes.join(split, "ballot_id").select("ballot_id", part.alias("part"), "member_id", "vote_type_id")
    tasks = _tasks(stored.agg(F.sum("n")).first()[0] or 0)
    dealt = ids.repartition(tasks, "ballot_id", "part")
    shares = _by_part(with_vote_type(dealt.join(voters, "member_id", "left"), tables))

    once = votes.join(split.select("ballot_id"), "ballot_id", "left_semi").join(voters, "member_id", "left")
    counts = with_vote_type(once, tables).withColumnRenamed("party_abbr", "party").groupBy(
        "ballot_id", "known", "party", "vote_type_id", "vote_type"
    ).agg(F.count(F.lit(1)).alias("votes"))
    by_party = _nested(counts.where("known"), ["ballot_id"], "all_party_votes", *_COUNTED)
    by_type = counts.groupBy("ballot_id", "vote_type_id", "vote_type").agg(F.sum("votes").alias("votes"))
    # a part that is computed, if always 1: by a constant Spark would not join, and move all parts of a ballot to one task
    head = (
        ballot_header(narrowed(tables, ballots).replaced(ballot=ballots)).withColumnRenamed("id", "ballot_id")
        .join(split, "ballot_id")
        .join(by_party, "ballot_id", "left")
        .join(_nested(by_type, ["ballot_id"], "all_totals", *_TYPED), "ballot_id", "left")
        .withColumn("part", F.least("parts", F.lit(1).cast("long"))).drop("parts")
    )
    names = [name for name in head.columns if name not in ("ballot_id", "part", "all_party_votes", "all_totals")]
    head = head.repartition(tasks, "ballot_id", "part")
    whole = head.join(shares, ["ballot_id", "part"], "full").join(split, "ballot_id")
    return whole.select(
        "ballot_id", "part", *names, "parts", F.col("all_party_votes").alias("party_votes"),
        F.col("all_totals").alias("totals"), F.col("single").alias("votes"),
    )


def ballot_document(
    tables: Tables, ballot_id: int | None = None, votes_per_part: int = VOTES_PER_PART
) -> DataFrame:
    """Header, party counts, totals and single votes of a ballot, one row for most.

    A ballot with more than ``votes_per_part`` votes comes in several rows, ``part``
    of ``parts``. Part 1 has the header, the counts of all parts and its share of the
    votes; the others have ballot_id, part, parts and their shares, with NULL headers
    and empty counts. No vote is left out or told twice, and no ballot of more than
    ``GATHERED`` votes and a part is ever gathered whole.

    The votes are read for their ballot's size and then once more, their ids shuffled
    once by ballot, where the header meets them. Only those of large ballots are
    shuffled by (ballot, part) instead, and counted again.
    """
    large = _large_ballots(tables, ballot_id, max(GATHERED, votes_per_part))
    if large.isEmpty():
        found = _whole(tables, ballot_id, None, votes_per_part)
    else:
        found = _whole(tables, ballot_id, large, votes_per_part).unionByName(_spread(tables, large, votes_per_part))
    return _or_empty(found, "party_votes", "totals", "votes")


def in_buckets(df: DataFrame, key: str, path: str, buckets: int | None = None) -> DataFrame:
    """``df`` written as a table whose files are the buckets of a key, sorted by it.

    A join or a count by the key of such tables with as many buckets moves no row. By
    default there are as many buckets as shuffle partitions; fewer would make Spark
    shuffle the table after all.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"buckets_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{path}/{name}").saveAsTable(name)
    return spark.table(name)


def bucketed_ballot_document(tables: Tables, votes_per_part: int = VOTES_PER_PART) -> DataFrame:
    """``ballot_document`` of all ballots, of tables whose votes are stored in buckets of the ballot.

    The votes are read once and not shuffled: their numbers in the ballot, their parts
    and the counts are made where they lie, and the headers come to them. A ballot is
    in one bucket, so one of very many votes is read by one task; ``ballot_document``
    spreads it over several.
    """
    placed = W.partitionBy("ballot_id").orderBy("vote_id")
    part = F.expr(f"(place - 1) div {votes_per_part} + 1")
    votes = _all_votes(tables, None).withColumn("place", F.row_number().over(placed)).withColumn("part", part)
    of_ballot = W.partitionBy("ballot_id").orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = _by_part(votes).select(
        "ballot_id", "part", "single", F.max("part").over(of_ballot).alias("parts"),
        F.flatten(F.collect_list("party_votes").over(of_ballot)).alias("by_party"),
        F.flatten(F.collect_list("by_type").over(of_ballot)).alias("by_type"),
    )
    head = ballot_header(tables).withColumnRenamed("id", "ballot_id")
    whole = head.join(shares, "ballot_id", "left").withColumn("part", F.coalesce("part", F.lit(1)).cast("long"))
    first = F.col("part") == 1
    nothing = {name: F.when(first, F.col(name)) for name in head.columns if name != "ballot_id"}
    columns = {
        **nothing, "parts": F.coalesce("parts", F.lit(1)).cast("long"),
        "party_votes": F.when(first, F.expr(_PARTY_TOTALS)), "totals": F.when(first, F.expr(_TOTALS)), "votes": F.col("single"),
    }
    shown = whole.withColumns(columns).drop("single", "by_party", "by_type")
    return _or_empty(shown, "party_votes", "totals", "votes")


def member_document(tables: Tables, member_id: int | None = None) -> DataFrame:
    """Header, counts, and counts by topic of a member in one row.

    Only counts are nested, so a row is bounded by topics times vote types.
    """
    stats = _nested(
        member_stats(tables, member_id), ["member_id"], "stats",
        "vote_type_id", "vote_type", "votes",
    )
    by_topic = _nested(
        member_topic_stats(tables, member_id), ["member_id"], "topic_stats",
        "topic", "topic_id", "vote_type_id", "vote_type", "votes",
    )
    head = member_header(tables, member_id).withColumnRenamed("id", "member_id")
    whole = head.join(stats, "member_id", "left").join(by_topic, "member_id", "left")
    return _or_empty(whole, "stats", "topic_stats")


def as_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, NULL fields included."""
    nested = [n for n, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    return df.withColumns(
        {name: F.to_json(name, {"ignoreNullFields": "false"}) for name in nested}
    )
