"""Every query by name, on the benchmark's tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers import bindings as b
from tellers.operators import keyed
from tellers.operators.bitmaps import id_bitmaps
from tellers.operators.paging import Page
from tellers.plans import build, counts, documents, labelling, loading, lookups, quality, repair
from tellers.plans.ballots import (
    BallotFilter, ballot_header, ballot_list, ballot_page, ballot_page_info, ballots_sorted,
)
from tellers.plans.breakdowns import ballot_party_votes, ballot_totals, ballot_votes
from tellers.plans.member_votes import (
    VoteFilter, member_votes, member_votes_page, member_votes_page_info,
)
from tellers.plans.members import (
    member_header, member_search, member_stats, member_stats_by_id, member_topic_stats,
    voting_members,
)
from tellers.plans.search import BILL_FIELDS, MEMBER_FIELDS, gram_index
from tellers.schema import RECORDS, TABLES
from tellers.session import cut, shared_folder
from tellers.sources.landed import completeness, explode_pages, rejected_pages, restrict_to_ids
from tellers.sources.store import Store, current_state
from tellers.streaming import pages as pages_stream
from tellers.streaming import votes as votes_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(make: Callable[[b.Source], DataFrame] | None = None, *, name: str | None = None):
    """Register a function of the source tables under its own or the given name."""
    if make is None:
        return lambda make: _query(make, name=name)
    _QUERIES[name or make.__name__] = lambda spark, folder: make(b.Source(spark, folder))
    return make


def _on_tables(name: str, make: Callable[..., DataFrame], *args, **named) -> None:
    """Register a query on the domain tables."""
    _QUERIES[name] = lambda spark, folder: make(b.tables(b.Source(spark, folder)), *args, **named)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- lists and profiles

_on_tables("voting_parties", lookups.voting_parties)
_on_tables("topics", lookups.topics)
_on_tables("ballot_types", lookups.ballot_types)
_on_tables("ballot_list", ballot_list)
_on_tables("ballots_by_topic", ballot_list, BallotFilter(topic_id=2))
_on_tables("ballots_by_type", ballot_list, BallotFilter(type_id=3))
_on_tables("ballots_passed", ballot_list, BallotFilter(passed=True))
_on_tables("ballots_search", ballot_list, BallotFilter(text=" L 1_7 "))
_on_tables(
    "ballots_between", ballot_list, BallotFilter(date_from="1996-03-01", date_to="1997-02-28")
)
_on_tables("ballots_sorted", ballots_sorted, sort="title", direction="asc")
_on_tables("ballot_page_info", ballot_page_info, BallotFilter(passed=False))
_on_tables("ballot_page", ballot_page, page=Page(3))
_on_tables(
    "ballot_page_by_title", ballot_page, BallotFilter(text="furn", date_from="1997-01-01"),
    Page(2, 20), sort="title", direction="asc",
)
_on_tables("ballot_page_far", ballot_page, page=Page(20), far=True)
_on_tables("member_votes_page_far", member_votes_page, page=Page(41), far=True)
_on_tables("ballot_header", ballot_header)
_on_tables("ballot_party_votes", ballot_party_votes)
_on_tables("ballot_votes", ballot_votes)
_on_tables("ballot_totals", ballot_totals)
_on_tables("voting_members", voting_members)
_on_tables("member_search", member_search, "ER 0000000_1")
_on_tables("member_search_all", member_search, "1", rows=None)
_on_tables("member_header", member_header)
_on_tables("member_stats", member_stats)
_on_tables("member_stats_by_id", member_stats_by_id)
_on_tables("member_topic_stats", member_topic_stats)
_on_tables("member_votes", member_votes)
_on_tables(
    "member_votes_filtered", member_votes,
    VoteFilter(topic_id=7, type_id=2, passed=True, text="U", vote_type_id=1),
)
_on_tables("member_votes_page", member_votes_page, page=Page(2))
_on_tables("member_votes_page_info", member_votes_page_info, VoteFilter(vote_type_id=2))


# ---- the same through an index, and from counts that are kept


def _folder(s: b.Source, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@_query
def ballots_search_indexed(s: b.Source) -> DataFrame:
    index = cut(gram_index(b.bill(s), BILL_FIELDS))
    return ballot_list(b.tables(s), BallotFilter(text=" L 1_7 "), index)


@_query
def ballots_search_title_indexed(s: b.Source) -> DataFrame:
    index = cut(gram_index(b.bill(s), BILL_FIELDS))
    return ballot_list(b.tables(s), BallotFilter(text="FURNITUR", passed=True), index)


@_query
def member_search_indexed(s: b.Source) -> DataFrame:
    index = cut(gram_index(b.member(s), MEMBER_FIELDS))
    return member_search(b.tables(s), "ER 0000000_1", index=index)


@_query
def member_votes_search_indexed(s: b.Source) -> DataFrame:
    index = cut(gram_index(b.bill(s), BILL_FIELDS))
    return member_votes(b.tables(s), VoteFilter(text="build", passed=True, vote_type_id=1), index=index)


def _kept_counts(s: b.Source) -> tuple[DataFrame, DataFrame]:
    """Counts of the first votes, then changed by the later votes and by new labels."""
    first, later = (b.votes_of(s.lineitem.where(f"l_shipdate {op} '1996-01-01'")) for op in ("<", ">="))
    before, after = b.first_labels(s), b.bill_topic(s)
    by_bill = cut(counts.bill_changes(first, b.ballot(s)))
    by_topic = cut(counts.topic_changes(by_bill, before))
    more = cut(counts.bill_changes(later, b.ballot(s)))
    by_topic = by_topic.unionByName(counts.topic_changes(more, before))
    by_bill = by_bill.unionByName(more)
    return by_bill, by_topic.unionByName(counts.relabelled(counts.summed(by_bill, counts.BY_BILL), before, after))


@_query
def member_stats_kept(s: b.Source) -> DataFrame:
    return counts.kept_member_stats(b.tables(s), _kept_counts(s)[0])


@_query
def member_topic_stats_kept(s: b.Source) -> DataFrame:
    return counts.kept_member_topic_stats(b.tables(s), _kept_counts(s)[1])


_on_tables("table_counts", quality.table_counts)
_on_tables("sample_members", repair.sample_members, seed=7)


@_query
def ballot_document(s: b.Source) -> DataFrame:
    return documents.as_json(documents.ballot_document(b.tables(s)))


@_query
def ballot_document_parts(s: b.Source) -> DataFrame:
    """What the documents hold when three votes fill a part."""
    whole = documents.ballot_document(b.tables(s), votes_per_part=3)
    counted = F.aggregate("totals", F.lit(0).cast("long"), lambda n, t: n + t["votes"])
    return whole.groupBy("ballot_id").agg(
        F.max("parts").alias("parts"), F.count("held_at").alias("headers"),
        F.sum(counted).alias("counted"), F.sum(F.size("votes")).alias("votes"),
    )


@_query
def member_document(s: b.Source) -> DataFrame:
    return documents.as_json(documents.member_document(b.tables(s)))


@_query
def ballot_document_bucketed(s: b.Source) -> DataFrame:
    """The documents of ballots and votes that are stored in buckets of the ballot."""
    folder = _folder(s, "buckets")
    votes = documents.in_buckets(b.vote(s), "ballot_id", folder)
    ballots = documents.in_buckets(b.ballot(s), "id", folder)
    return documents.as_json(documents.bucketed_ballot_document(b.tables(s, vote=votes, ballot=ballots)))


def _last(df: DataFrame, key: str) -> int:
    """A key that the data has."""
    return df.agg(F.max(key)).first()[0]


@_query
def one_ballot_document(s: b.Source) -> DataFrame:
    return documents.as_json(documents.ballot_document(b.tables(s), _last(s.orders, "o_orderkey")))


@_query
def one_member_document(s: b.Source) -> DataFrame:
    return documents.as_json(documents.member_document(b.tables(s), _last(s.supplier, "s_suppkey")))


@_query
def one_member_votes_page(s: b.Source) -> DataFrame:
    return member_votes_page(b.tables(s), member_id=_last(s.supplier, "s_suppkey"), page=Page(1))


@_query
def sample_bills(s: b.Source) -> DataFrame:
    return repair.sample_bills(b.bill(s))


@_query
def constraint_report(s: b.Source) -> DataFrame:
    names = ("ballot_type", "vote_type", "party", "member", "bill", "topic", "bill_topic", "ballot", "vote")
    return quality.constraint_report(b.damaged_tables(s), names)


@_query
def append_report(s: b.Source) -> DataFrame:
    """What later votes would bring in, told from bitmaps of the ids that are stored."""
    votes = b.numbered_votes(s)
    known = {
        "ballot": s.orders.where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS id"),
        "member": s.supplier.where("s_acctbal >= 0").selectExpr("s_suppkey AS id"),
        "vote_type": b.vote_type(s).where("id <> 2").select("id"),
    }
    sets = {name: cut(id_bitmaps(ids)) for name, ids in known.items()}
    stored = cut(id_bitmaps(votes.where("l_shipdate < '1997-01-01'")))
    return quality.append_report("vote", votes.where("l_shipdate >= '1997-01-01'").drop("l_shipdate"), stored, sets)


# ---- ingest

_EVENT_RECORD = (
    T.StructType().add("event_id", "long").add("ts", "string").add("user_id", "long")
    .add("event_type", "string").add("value", "double").add("props", "string")
)


@_query
def ingest_pages(s: b.Source) -> DataFrame:
    records = explode_pages(b.event_pages(s), _EVENT_RECORD)
    return records.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query
def ingest_completeness(s: b.Source) -> DataFrame:
    return completeness(b.event_pages(s), _EVENT_RECORD, key="event_id")


@_query
def ingest_completeness_damaged(s: b.Source) -> DataFrame:
    return completeness(b.damaged_event_pages(s), _EVENT_RECORD, key="event_id")


@_query(name="rejected_pages")
def pages_set_aside(s: b.Source) -> DataFrame:
    return rejected_pages(b.damaged_event_pages(s), _EVENT_RECORD).select("page")


@_query
def rejected_votes(s: b.Source) -> DataFrame:
    return loading.checked_votes(*b.votes_to_check(s)).where("reason IS NOT NULL")


@_query
def rejected_ballots(s: b.Source) -> DataFrame:
    checked = loading.checked_ballots(*b.ballots_to_check(s)).where("reason IS NOT NULL")
    return checked.select("id", "type_id", "bill_id", "reason")


@_query
def read_by_ids(s: b.Source) -> DataFrame:
    return restrict_to_ids(b.raw_bills(s), b.ballot(s).where("held_at >= '2000-06-01'").select("bill_id"))


_LINE_KEY = ["l_orderkey", "l_suppkey"]
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_extendedprice"]


def _stored_and_shipped(s: b.Source) -> tuple[DataFrame, DataFrame]:
    lines = s.lineitem.select(*_LINE_KEY, *_LINE_ORDER, "l_quantity", "l_shipdate")
    stored = keyed.latest(lines.where("l_shipdate < '1998-01-01'"), _LINE_KEY, _LINE_ORDER)
    return stored, lines.where("l_shipdate >= '1998-01-01'")


@_query
def upsert_last_wins(s: b.Source) -> DataFrame:
    stored, shipped = _stored_and_shipped(s)
    return keyed.upsert(stored, shipped, _LINE_KEY, _LINE_ORDER)


@_query
def insert_ignore(s: b.Source) -> DataFrame:
    stored, shipped = _stored_and_shipped(s)
    return keyed.insert_ignore(stored, shipped, _LINE_KEY, _LINE_ORDER)


@_query
def lookup_load(s: b.Source) -> DataFrame:
    records = explode_pages(b.ballot_type_pages(s), RECORDS["ballot_type"], arrival=F.col("page"))
    return loading.load_lookup(b.stale_ballot_types(s), records)


@_query
def topic_seed(s: b.Source) -> DataFrame:
    return loading.seed_topics(b.first_topics(s))


@_query
def load_progress(s: b.Source) -> DataFrame:
    return current_state(b.ledger(s))


@_query
def incremental_votes(s: b.Source) -> DataFrame:
    stored = b.votes_of(s.lineitem.where("l_shipdate < '1996-01-01'"))
    return loading.incremental_votes(stored, b.vote(s))


@_query
def stream_votes(s: b.Source) -> DataFrame:
    """Stream the votes into a new log, stop, and start again on the same checkpoint."""
    folder = f"{shared_folder(s.spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        votes = b.votes_of(s.stream("lineitem"))
        votes_stream.stream_votes(votes, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return votes_stream.read_log(s.spark, f"{folder}/log", b.vote(s).schema)


def _land_events(s: b.Source) -> str:
    """Stream damaged pages in two runs on one checkpoint; the folder of what they leave."""
    folder = _folder(s, "landing")
    pages = cut(b.damaged_event_pages(s))
    for part in range(2):
        pages.where(f"page % 2 = {part}").select("value").write.mode("append").text(f"{folder}/feed")
        pages_stream.land(
            s.spark, f"{folder}/feed", _EVENT_RECORD, f"{folder}/out", f"{folder}/checkpoint", key="event_id", files_per_trigger=4,
        ).awaitTermination()
    return f"{folder}/out"


@_query
def stream_rejected_pages(s: b.Source) -> DataFrame:
    first_id = F.regexp_extract("page", r'"(?:event_id|was)":(\d+)', 1).cast("long")
    return pages_stream.rejected_so_far(s.spark, _land_events(s)).select(F.floor(first_id / 100).alias("page"))


@_query
def stream_completeness(s: b.Source) -> DataFrame:
    return pages_stream.completeness_so_far(s.spark, _land_events(s))


@_query
def stream_last_fetched(s: b.Source) -> DataFrame:
    """Votes that come again with a smaller value, in the same micro-batch and in a later one."""
    folder = _folder(s, "votes")
    for feeds in (((9, 1), (2, 2)), ((1, 4),)):
        for kind, every in feeds:
            b.vote_pages(s, kind, every).select("value").write.mode("append").text(f"{folder}/feed")
        pages_stream.land(s.spark, f"{folder}/feed", RECORDS["vote"], f"{folder}/out", f"{folder}/landed").awaitTermination()
        records = build.build_votes(pages_stream.record_stream(s.spark, f"{folder}/out", RECORDS["vote"]))
        votes_stream.stream_votes(records, f"{folder}/log", f"{folder}/state").awaitTermination()
    return votes_stream.read_log(s.spark, f"{folder}/log", TABLES["vote"])


@_query
def incremental_append(s: b.Source) -> DataFrame:
    """What a load adds to stored votes of which only the ballots' bitmaps are read."""
    stored = b.votes_of(s.lineitem.where("l_shipdate < '1996-01-01'"))
    return loading.votes_to_add(cut(id_bitmaps(stored, "ballot_id")), b.vote(s))


@_query
def store_upsert(s: b.Source) -> DataFrame:
    """Bills in a store after an upsert that writes the partitions its ids name."""
    store = Store.create(s.spark, _folder(s, "store"))
    store.write("bill", b.bill(s))
    store.upsert("bill", b.changed_bills(s), ["title"])
    return store.read("bill")


# ---- build and repair


@_query
def build_parties(s: b.Source) -> DataFrame:
    return build.build_parties(b.actors(s))


@_query
def build_members(s: b.Source) -> DataFrame:
    return build.build_members(b.actors(s))


@_query
def build_ballots(s: b.Source) -> DataFrame:
    return build.build_ballots(b.raw_ballots(s), b.steps(s), b.PERIOD)


@_query
def build_bills(s: b.Source) -> DataFrame:
    return build.build_bills(b.raw_bills(s), build_ballots(s))


@_query
def xml_party(s: b.Source) -> DataFrame:
    return repair.member_parties(b.actors(s)).select("id", "short", "full")


@_query
def xml_party_codes(s: b.Source) -> DataFrame:
    return repair.party_codes(repair.member_parties(b.actors(s)))


@_query
def xml_party_dim(s: b.Source) -> DataFrame:
    return repair.add_parties(b.first_parties(s), cut(repair.member_parties(b.actors(s))))


@_query
def repair_members(s: b.Source) -> DataFrame:
    parsed = cut(repair.member_parties(b.actors_twice(s), "arrival"))  # parse every biography once
    parties = repair.add_parties(b.first_parties(s), parsed)
    return repair.repair_members(build_members(s), parsed, parties)


@_query
def repair_numbers(s: b.Source) -> DataFrame:
    return repair.repair_numbers(b.bill(s), b.refetched_bills(s))


@_query
def numbered_bills(s: b.Source) -> DataFrame:
    return repair.numbered_bills(b.bill(s), b.refetched_bills(s))


# ---- labelling


@_query
def unlabelled_bills(s: b.Source) -> DataFrame:
    return labelling.unlabelled_bills(b.document_bills(s), b.labelled_documents(s))


@_query
def prompt_batches(s: b.Source) -> DataFrame:
    bills = labelling.unlabelled_bills(
        b.document_bills(s), b.labelled_documents(s), ordered=False
    )
    return labelling.prompt_batches(bills)


def rule_of_thumb(prompt: str) -> str:
    """A stand-in for a model: topic by the length of the title; fails on some batches."""
    items = re.findall(r"^\d+\. \[id=(\d+)\] (.*)$", prompt, re.MULTILINE)
    if int(items[0][0]) % 7 == 0:
        raise RuntimeError(f"no answer for {items[0][0]}")
    return json.dumps(
        [{"sag_id": int(i), "kategorier": [f"len{len(title)}"]} for i, title in items],
        separators=(",", ":"),
    )


@_query
def label_batches(s: b.Source) -> DataFrame:
    return labelling.label_batches(prompt_batches(s), rule_of_thumb)


class Busy:
    """The same stand-in behind a service that turns every prompt down twice, in each task."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        if self.seen[prompt] < 3:
            raise ConnectionError("busy")
        return rule_of_thumb(prompt)


@_query
def label_batches_retried(s: b.Source) -> DataFrame:
    pace = labelling.Pace(at_once=4, tries=4, first_wait=0.01)
    return labelling.label_batches(prompt_batches(s), Busy(), pace=pace)


@_query
def parse_responses(s: b.Source) -> DataFrame:
    return labelling.parse_responses(b.answers(s))


@_query
def rejected_responses(s: b.Source) -> DataFrame:
    return labelling.rejected_responses(b.answers(s)).select("batch")


@_query
def ingest_labels(s: b.Source) -> DataFrame:
    return labelling.ingest_labels(
        parse_responses(s), b.source_topics(s), b.known_documents(s), b.stored_labels(s)
    )


@_query
def orphan_labels(s: b.Source) -> DataFrame:
    return labelling.orphan_labels(parse_responses(s), b.source_topics(s), b.known_documents(s))


@_query
def label_counts(s: b.Source) -> DataFrame:
    return labelling.label_counts(parse_responses(s), b.source_topics(s))
