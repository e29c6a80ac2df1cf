"""The benchmark's tables as the parliament's tables and as landed feed records.

Orders stand for ballots, line items for votes, suppliers for members, customers
for bills, documents for bills to label.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellers.plans.tables import Tables

_DRIVER = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}

PERIOD = "1998-01-01"
_ISO = "\"yyyy-MM-dd'T'HH:mm:ss\""


class Source:
    """The benchmark tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        """A table, read with its schema; every use reads it anew."""
        if name not in _DRIVER:
            raise AttributeError(name)
        return self.spark.read.schema(_DRIVER[name]).parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        reader = self.spark.readStream.schema(_DRIVER[name])
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


# The market segments are topics 1 to 5, the regions topics 6 to 10.
_SEGMENT_ID = """CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
    WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS BIGINT)"""
_VOTE_TYPE = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS vote_type_id"


def places(s: Source) -> DataFrame:
    """Nations with their regions: 25 rows at every scale."""
    return F.broadcast(s.nation.join(F.broadcast(s.region), F.expr("n_regionkey = r_regionkey")))


# ---- domain tables


def ballot_type(s: Source) -> DataFrame:
    return s.orders.selectExpr(
        "CAST(substr(o_orderpriority, 1, 1) AS INT) AS id", "substr(o_orderpriority, 3) AS type"
    ).distinct()


def vote_type(s: Source) -> DataFrame:
    return s.spark.sql("SELECT * FROM VALUES (1, 'For'), (2, 'Against'), (3, 'Absent') AS v(id, type)")


def party(s: Source) -> DataFrame:
    return places(s).selectExpr("n_nationkey AS id", "n_name AS abbreviation", "r_name AS name")


def member(s: Source) -> DataFrame:
    nations = F.broadcast(s.nation)  # 25 rows at every scale
    has_party = F.expr("n_nationkey = s_nationkey AND s_suppkey % 10 <> 0")
    return s.supplier.join(nations, has_party, "left").selectExpr(
        "s_suppkey AS id", "substr(s_name, 1, 8) AS first_name", "substr(s_name, 10) AS last_name",
        "n_name AS party_abbr", "n_nationkey AS party_id",
    )


def bill(s: Source) -> DataFrame:
    return s.customer.selectExpr(
        "c_custkey AS id", "c_name AS title",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS short_title",
        "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment || ' resume of ' || c_name END AS resume", "'L ' || CAST(c_custkey AS STRING) AS number",
        "c_nationkey AS type_id", "c_nationkey % 5 AS period_id",
    )


def topic(s: Source) -> DataFrame:
    segments = s.customer.selectExpr(f"{_SEGMENT_ID} AS id", "c_mktsegment AS name").distinct()
    return segments.union(s.region.selectExpr("CAST(r_regionkey + 6 AS BIGINT)", "r_name"))


def bill_topic(s: Source) -> DataFrame:
    nations = F.broadcast(s.nation)  # 25 rows at every scale
    in_credit = s.customer.where("c_acctbal >= 0")
    return in_credit.join(nations, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_custkey AS bill_id",
        f"explode(array({_SEGMENT_ID}, CAST(n_regionkey + 6 AS BIGINT))) AS topic_id",
    )


def ballot(s: Source) -> DataFrame:
    return s.orders.selectExpr(
        "o_orderkey AS id", "CAST(o_orderkey % 1000 AS INT) AS number",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS conclusion", "o_orderstatus = 'F' AS passed",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || ' noted' END AS comment", "o_orderdate AS held_at",
        "CAST(substr(o_orderpriority, 1, 1) AS INT) AS type_id",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS bill_id",
    )


def votes_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
        "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id",
        "l_orderkey AS ballot_id", "l_suppkey AS member_id", _VOTE_TYPE,
    )


def vote(s: Source) -> DataFrame:
    return votes_of(s.lineitem)


_MAKERS = {
    f.__name__: f
    for f in (ballot_type, vote_type, party, member, bill, topic, bill_topic, ballot, vote)
}


def tables(s: Source, **other: DataFrame) -> Tables:
    """The domain tables; ``other`` replaces some of them."""
    makers = {name: partial(make, s) for name, make in _MAKERS.items()}
    makers.update({name: (lambda df=df: df) for name, df in other.items()})
    return Tables(makers, bounded={"vote_type"} - set(other))  # three rows


def damaged_tables(s: Source) -> Tables:
    """The domain tables with broken keys, references and names."""
    members = s.supplier.where("s_acctbal >= 0").selectExpr("s_suppkey AS id")
    members = member(s).join(members, "id", "left_semi").selectExpr(
        "id", "first_name", "CASE WHEN party_id <> 3 THEN last_name END AS last_name",
        "party_abbr", "party_id",
    )
    votes = s.lineitem.selectExpr(
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS id",
        "l_orderkey AS ballot_id", "l_suppkey AS member_id",
        "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS vote_type_id",
    )
    bills = s.customer.where("c_acctbal < 5000").selectExpr("c_custkey AS id")
    return tables(s, member=members, vote=votes, bill=bill(s).join(bills, "id", "left_semi"))


# ---- landed pages and raw feed records


def pages_of(records: DataFrame, position: Column) -> DataFrame:
    """(page, value): envelopes of 100 records each, as JSON text."""
    total = records.agg(F.count(F.lit(1)).cast("string").alias("n")).scalar()
    return (
        records.select(F.struct("*").alias("r"), position.alias("page"))
        .groupBy("page").agg(F.collect_list("r").alias("value"))
        .select("page", F.to_json(F.struct(total.alias("odata.count"), "value")).alias("value"))
    )


def event_pages(s: Source) -> DataFrame:
    records = s.events.selectExpr(
        "event_id", "CAST(ts AS STRING) AS ts", "user_id", "event_type", "value", "props"
    )
    return pages_of(records, F.expr("event_id div 100"))


def damaged_event_pages(s: Source) -> DataFrame:
    """The same pages, some cut off and some with a text for an id."""
    pages = event_pages(s)
    return pages.selectExpr("page", """CASE
        WHEN page % 7 = 0 THEN substr(value, 1, length(value) - 20)
        WHEN page % 7 = 3 THEN replace(value, '"event_id":', '"event_id":"x","was":') ELSE value END AS value""")


def vote_records(s: Source, kind: int, every: int = 1) -> DataFrame:
    """Orders as votes of one type, of every so-many-th order."""
    return s.orders.where(f"o_orderkey % {every} = 0").selectExpr(
        "o_orderkey AS id", "o_orderkey AS afstemningid", "o_custkey AS `aktørid`", f"{kind}L AS typeid"
    )


def vote_pages(s: Source, kind: int, every: int = 1) -> DataFrame:
    return pages_of(vote_records(s, kind, every), F.expr("id div 100"))


def ballot_type_pages(s: Source) -> DataFrame:
    """A feed that repeats each ballot type for every order that has it, first misnamed."""
    records = s.orders.selectExpr(
        "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id",
        "CASE WHEN o_orderkey < 300 THEN 'Z ' ELSE '' END || substr(o_orderpriority, 3) AS type", "o_orderkey",
    )
    return pages_of(records, F.expr("o_orderkey div 100"))


def stale_ballot_types(s: Source) -> DataFrame:
    """Ballot types 5 to 9 under old names; 5 is in the feed, too."""
    return s.orders.selectExpr(
        "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 4 AS id",
        "'OLD ' || substr(o_orderpriority, 3) AS type",
    ).distinct()


def actors(s: Source) -> DataFrame:
    """Suppliers as persons and nations as groups; names and codes partly missing."""
    xml = """'<member><firstname>' || substr(s_name, 1, 8) || '</firstname><partyShortname>' ||
        substr(n_name, 1, 8) || '</partyShortname>' ||
        CASE WHEN s_suppkey % 4 <> 0 THEN '<party>' || n_name || ' ' || r_name || '</party>'
             ELSE '' END ||
        CASE WHEN s_suppkey % 6 = 0 THEN '<partyShortname>LATER</partyShortname>' ELSE '' END ||
        CASE WHEN s_suppkey % 10 <> 0 THEN '</member>' ELSE '' END"""
    persons = s.supplier.join(places(s), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey AS id", "5 AS typeid",
        "CASE WHEN s_suppkey % 13 <> 0 THEN substr(s_name, 1, 8) END AS fornavn",
        "substr(s_name, 10) AS efternavn", "s_name AS navn",
        "CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '' "
        "ELSE substr(n_name, 1, 8) END AS gruppenavnkort",
        f"CASE WHEN s_suppkey % 17 <> 0 THEN {xml} END AS biografi",
    )
    groups = places(s).selectExpr(
        "CAST(n_nationkey AS BIGINT) + 10000000000 AS id", "9 AS typeid", "' Group' AS fornavn",
        "CASE WHEN n_nationkey <> 7 THEN n_name END AS efternavn",
        "CASE WHEN n_nationkey % 5 = 2 THEN NULL WHEN n_nationkey = 3 THEN '' ELSE r_name END "
        "AS navn",
        "CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey = 23 THEN '' "
        "ELSE substr(n_name, 1, 8) END AS gruppenavnkort",
        "CAST(NULL AS STRING) AS biografi",
    )
    return persons.unionByName(groups)


def actors_twice(s: Source) -> DataFrame:
    """The actors, each after an earlier version whose biography is broken."""
    now = actors(s).selectExpr("*", "id AS arrival")
    before = now.selectExpr("* EXCEPT (biografi, arrival)", "'<member>' AS biografi", "id - 1000000000000 AS arrival")
    return before.unionByName(now)


def raw_ballots(s: Source) -> DataFrame:
    """Line items as ballots, each after an earlier version without a step."""
    now = _raw_ballots(s).selectExpr("*", "2 AS arrival")
    before = now.selectExpr(
        "* EXCEPT (konklusion, sagstrinid, arrival)", "'before' AS konklusion",
        "CAST(NULL AS BIGINT) AS sagstrinid", "1 AS arrival",
    )
    return now.unionByName(before)


def _raw_ballots(s: Source) -> DataFrame:
    totals = s.lineitem.groupBy("l_orderkey").agg(
        F.expr("min(l_linenumber) AS nummer"), F.expr("max(l_linestatus) AS konklusion"),
        F.expr("max(l_returnflag) AS flag"), F.expr("max(l_shipdate) AS shipped"),
    )
    return totals.selectExpr(
        "l_orderkey AS id", "nummer", "konklusion",
        "CASE WHEN flag <> 'N' THEN flag = 'R' END AS vedtaget",
        "CASE WHEN nummer % 2 = 0 THEN flag END AS kommentar",
        f"date_format(shipped, {_ISO}) AS opdateringsdato", "nummer % 5 + 1 AS typeid",
        "CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 51 = 0 THEN 0 "
        "ELSE l_orderkey END AS sagstrinid",
    )


def steps(s: Source) -> DataFrame:
    """Orders as case steps, each after an earlier version of another date and bill."""
    now = _steps(s).selectExpr("*", "2 AS arrival")
    before = now.selectExpr("id", "'2030-01-01T00:00:00' AS dato", "-1L AS sagid", "1 AS arrival")
    return now.unionByName(before)


def _steps(s: Source) -> DataFrame:
    return s.orders.selectExpr(
        "o_orderkey AS id",
        "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL "
        "WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN '' "
        f"ELSE date_format(o_orderdate, {_ISO}) END AS dato",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS sagid",
    )


def raw_bills(s: Source) -> DataFrame:
    return bill(s).selectExpr(
        "id", "title AS titel", "short_title AS titelkort", "resume", "number AS nummer",
        "type_id AS typeid", "period_id AS periodeid",
    )


def refetched_bills(s: Source) -> DataFrame:
    """Bill records of the customers in credit, with other numbers, some NULL; each came before, too."""
    now = s.customer.where("c_acctbal >= 0").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_nationkey % 6 <> 0 THEN 'B ' || CAST(c_custkey AS STRING) END AS nummer", "2 AS arrival",
    )
    return now.unionByName(now.selectExpr("id", "'Z ' || CAST(id AS STRING) AS nummer", "1 AS arrival"))


def changed_bills(s: Source) -> DataFrame:
    """New titles for some bills, and bills that are new, in a range of ids of their own."""
    renamed = bill(s).where("id % 3 = 0 AND id <= 50").selectExpr("* EXCEPT (title)", "title || ' B' AS title")
    added = bill(s).where("id % 10 = 0").selectExpr("* EXCEPT (id)", "id + 7000000 AS id")
    return renamed.unionByName(added)


def first_labels(s: Source) -> DataFrame:
    """Labels before they were changed: fewer, and some that are wrong."""
    right = bill_topic(s).where("bill_id % 4 <> 0")
    return right.unionByName(bill_topic(s).where("bill_id % 5 = 0").selectExpr("bill_id", "topic_id % 10 + 1 AS topic_id"))


def votes_to_check(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Votes, members and vote types, of which some votes name none."""
    members = member(s).join(s.supplier.where("s_acctbal >= 0").selectExpr("s_suppkey AS id"), "id", "left_semi")
    return vote(s), members, vote_type(s).where("id <> 2")


def ballots_to_check(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ballots, ballot types and bills, of which some ballots name none."""
    bills = bill(s).where("number NOT LIKE '%5'")
    return ballot(s), ballot_type(s).where("id <> 4"), bills


def numbered_votes(s: Source) -> DataFrame:
    """Line items as votes with a number for an id, which some share; some without a type."""
    return s.lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS ballot_id", "l_suppkey AS member_id",
        "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS vote_type_id", "l_shipdate",
    )


def first_parties(s: Source) -> DataFrame:
    """Parties stored before the repair: the nations of the first region."""
    return places(s).where("n_regionkey = 0").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id", "substr(n_name, 1, 8) AS abbreviation",
        "n_name || ' ' || r_name AS name",
    )


def first_topics(s: Source) -> DataFrame:
    """Topics stored before the seed: the market segments, two under seeded names."""
    return s.customer.selectExpr(
        f"{_SEGMENT_ID} AS id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Bolig' WHEN 'MACHINERY' THEN 'Energi' "
        "ELSE c_mktsegment END AS name",
    ).distinct()


def ledger(s: Source) -> DataFrame:
    """Events as progress notes: the user is the key."""
    return s.events.selectExpr(
        "'user:' || CAST(user_id AS STRING) AS key", "event_type AS value", "event_id AS seq"
    )


# ---- bills to label and model answers


def document_bills(s: Source) -> DataFrame:
    return s.documents.selectExpr(
        "doc_id AS id",
        "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' "
        "ELSE lang || ' ' || CAST(doc_id AS STRING) END AS title",
        "CASE WHEN doc_id % 3 <> 0 THEN source END AS short_title",
        "CASE WHEN doc_id % 8 <> 0 THEN text END AS resume",
    )


def labelled_documents(s: Source) -> DataFrame:
    return s.labels.selectExpr("doc_id AS bill_id", "quality AS topic_id")


def answers(s: Source) -> DataFrame:
    """Answers for 15 documents each: some fenced, some cut off."""
    batches = s.documents.selectExpr("doc_id", "source", "lang", "doc_id div 15 AS batch")
    whole = batches.groupBy("batch").agg(F.expr(
        "to_json(collect_list(struct(doc_id AS sag_id, array(source, lang, 'Ukendt') "
        "AS kategorier))) AS json"
    ))
    text = "CASE WHEN batch % 7 = 0 THEN substr(json, 1, length(json) - 2) ELSE json END"
    return whole.selectExpr(
        "batch",
        f"CASE WHEN batch % 5 = 0 THEN ' ```json\\n' || {text} || '\\n```\\n' "
        f"ELSE '\\n' || {text} || ' ' END AS response",
    )


def source_topics(s: Source) -> DataFrame:
    """Document sources as topics, but for one."""
    return s.documents.where("source <> 'src7'").selectExpr(
        "CAST(substr(source, 4) AS BIGINT) + 1 AS id", "source AS name"
    ).distinct()


def stored_labels(s: Source) -> DataFrame:
    """Labels stored before: the source topic of the documents of good quality."""
    good = s.labels.where("quality = 1")
    return s.documents.where("source <> 'src7'").join(good, "doc_id", "left_semi").selectExpr(
        "doc_id AS bill_id", "CAST(substr(source, 4) AS BIGINT) + 1 AS topic_id"
    )


def known_documents(s: Source) -> DataFrame:
    """The documents that exist as bills: all but the shortest."""
    return s.documents.where("n_chars >= 400").selectExpr("doc_id AS id")
