"""Query semantics on the small parliament."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frames import DAY, ROWS, frames, rows
from tellers.operators.paging import Page
from tellers.plans import documents, lookups
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


@pytest.fixture(scope="module")
def t(spark):
    return frames(spark)


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize("text, found", [
    ("miljø", {100}),  # only ASCII letters fold
    ("MILJØ", {101}),
    ("MILJ", {100, 101}),
    ("100%", {100}),
    ("l%1", {100}),
    ("gr_n_a", {100}),
    ("l _", {100, 101, 102}),
    ("a\\b", {102}),
    ("\\", {102}),
    ("  ", {100, 101, 102, 103, 104}),
])
def test_text_filter(t, text, found):
    assert ids(ballot_list(t, BallotFilter(text=text))) == found


def test_topic_lists(t):
    listed = {r["id"]: r["topics"] for r in ballot_list(t).collect()}
    assert listed == {
        100: "Bolig, Energi, Sundhed", 101: "Bolig", 102: None, 103: None, 104: None,
    }
    head = {r["id"]: r["topics"] for r in ballot_header(t).collect()}
    assert head[100] == "Bolig,Energi,Sundhed" and head[103] is None


def test_missing_bill_and_type_give_nulls(t):
    row = ballot_list(t).where("id = 104").first()
    assert (row["bill_id"], row["ballot_type"], row["type_id"]) == (None, None, 9)


@pytest.mark.parametrize("f, found", [
    (BallotFilter(topic_id=2), {100, 101}),
    (BallotFilter(type_id=1), {100, 102, 103}),
    (BallotFilter(passed=False), {101, 103}),
    (BallotFilter(date_from="2024-05-02"), {102}),
    (BallotFilter(date_to="2024-05-01"), {100, 101, 104}),
    (BallotFilter(date_to="2024-05-01", whole_day=False), set()),
    (BallotFilter(date_to="2024-05-02T09:30:00"), {100, 101, 102, 104}),
    (BallotFilter(date_from="2024-05-01", date_to="2024-05-02", passed=True), {100, 102, 104}),
])
def test_filters_and_their_totals(t, f, found):
    assert ids(ballot_list(t, f)) == found
    info = ballot_page_info(t, f, Page(1, 2)).first()
    assert (info["total"], info["pages"]) == (len(found), -(-len(found) // 2))


@pytest.mark.parametrize("sort, direction, order", [
    (None, None, [102, 100, 101, 104, 103]),
    ("date", "asc", [103, 100, 101, 104, 102]),
    ("nonsense", "sideways", [102, 100, 101, 104, 103]),
    ("title", "asc", [102, 103, 104, 101, 100]),
    ("title", "desc", [100, 101, 102, 103, 104]),
    ("bill_number", "desc", [102, 101, 100, 103, 104]),
    ("passed", "asc", [101, 103, 100, 102, 104]),
    ("type", "desc", [104, 101, 100, 102, 103]),
])
def test_sort_and_pages_make_the_list(t, sort, direction, order):
    assert [r["id"] for r in ballots_sorted(t, sort=sort, direction=direction).collect()] == order
    whole = ballots_sorted(t, sort=sort, direction=direction).collect()
    paged = [
        row for n in (1, 2, 3, 4)
        for row in ballot_page(t, page=Page(n, 2), sort=sort, direction=direction).collect()
    ]
    assert paged == whole


@pytest.mark.parametrize("sort, direction", [("date", "desc"), ("date", "asc"), ("title", "asc"), ("title", "desc")])
def test_page_after_a_key(t, sort, direction):
    whole = ballots_sorted(t, sort=sort, direction=direction).collect()
    column = {"date": "held_at", "title": "short_title"}[sort]
    for i, row in enumerate(whole):
        page = ballot_page(
            t, page=Page(1, 10), sort=sort, direction=direction, after=(row[column], row["id"])
        )
        assert page.collect() == whole[i + 1:]


def test_a_long_page_takes_the_written_way(t):
    assert len(ballot_page(t, page=Page(1, 20_000)).collect()) == 5


def test_page_arguments():
    for bad in ((0, 5), (1, 0), (-1, 5)):
        with pytest.raises(ValueError):
            Page(*bad)


def test_party_votes_keep_members_without_party(t):
    got = rows(ballot_party_votes(t, 100), "party", "vote_type", "votes")
    assert got == [(None, "For", 1), ("A", "For", 2), ("B", "Against", 1)]


def test_party_votes_sum_to_totals_of_known_members(t):
    by_party = ballot_party_votes(t).groupBy("ballot_id", "vote_type").agg(F.sum("votes").alias("v"))
    known = {(r[0], r[1]): r[2] for r in by_party.collect()}
    totals = {(r["ballot_id"], r["vote_type"]): r["votes"] for r in ballot_totals(t).collect()}
    assert {k: v for k, v in totals.items() if k != (102, "Against")} == known
    assert totals[(102, "Against")] == 1  # a member nobody knows


def test_votes_of_a_ballot_are_sorted(t):
    assert rows(ballot_votes(t, 100), "party_abbr", "last_name") == [
        (None, "Friis"), ("A", "Juhl"), ("A", "Møller"), ("B", "Dahl"),
    ]


def test_unknown_vote_types(t):
    """Left out of counts, kept with NULL in the vote list."""
    assert rows(ballot_totals(t, 104)) == []
    assert member_votes(t).where("ballot_id = 104").first()["vote_type"] is None


def test_member_lists_need_a_vote_headers_do_not(t):
    assert ids(voting_members(t)) == {1, 2, 3, 4}
    assert ids(member_header(t)) == {1, 2, 3, 4, 5}
    assert rows(member_header(t, 5)) == [(5, "Eva", "Kjær", "B", "Beta")]


@pytest.mark.parametrize("text, found", [
    ("bo d", [2]), ("b", [2]), ("a", [3, 4, 1, 2]), ("eva", []), ("åse", []), ("ÅSE", [1]), ("Åse", [1]), ("", [3, 4, 1, 2]),
])
def test_member_search(t, text, found):
    assert [r["id"] for r in member_search(t, text).collect()] == found


def test_member_search_stops_at_fifty(spark):
    many = [(i, "Ann", f"N{i:03}", "A", 1) for i in range(200)]
    t = frames(spark, member=many, vote=[(i, 100, i, 1) for i in range(200)])
    assert [r["id"] for r in member_search(t, "ann").collect()] == list(range(50))
    assert voting_members(t).count() == 200


def test_parties_of_one_abbreviation(t):
    assert rows(lookups.voting_parties(t)) == [("A", "Alpha"), ("A", "Alpha Old"), ("B", "Beta")]
    assert rows(lookups.topics(t)) == [(2, "Bolig"), (1, "Energi"), (3, "Sundhed")]
    assert rows(lookups.ballot_types(t)) == [(1, "Final"), (2, "Motion")]


def test_member_statistics(t):
    assert rows(member_stats(t, 1), "vote_type", "votes") == [("For", 3), ("Absent", 1)]
    assert rows(member_stats_by_id(t, 1)) == [(1, 1, "For", 3), (1, 3, "Absent", 1)]
    assert rows(member_topic_stats(t, 1), "topic", "vote_type", "votes") == [
        ("Bolig", "For", 1), ("Bolig", "Absent", 1), ("Energi", "For", 1), ("Sundhed", "For", 1),
    ]


@pytest.mark.parametrize("f, found", [
    (VoteFilter(), {1, 5, 7, 8}),
    (VoteFilter(topic_id=2), {1, 5}),
    (VoteFilter(type_id=1), {1, 7}),
    (VoteFilter(passed=True), {1, 7, 8}),
    (VoteFilter(text="L 1"), set()),  # the number is not searched here
    (VoteFilter(text="miljø"), {1}),
    (VoteFilter(vote_type_id=3), {5}),
])
def test_member_votes(t, f, found):
    assert {r["vote_id"] for r in member_votes(t, f, 1).collect()} == found
    info = member_votes_page_info(t, f, 1, Page(1, 3)).collect()
    assert [r["total"] for r in info] == ([len(found)] if found else [])


def test_member_vote_pages(t):
    paged = [r for n in (1, 2, 3) for r in member_votes_page(t, page=Page(n, 3)).collect()]
    assert [r["vote_id"] for r in paged] == [7, 10, 1, 2, 3, 4, 5, 6, 8]
    assert {tuple(r) for r in paged} == {tuple(r) for r in member_votes(t).collect()}
    assert paged[0]["held_at"].day == 2 and paged[2]["held_at"] == DAY


def test_documents(t):
    whole = {r["ballot_id"]: r for r in documents.ballot_document(t).collect()}
    assert set(whole) == {100, 101, 102, 103, 104}
    row = whole[100]
    assert [(p["party"], p["vote_type"], p["votes"]) for p in row["party_votes"]] == [
        (None, "For", 1), ("A", "For", 2), ("B", "Against", 1),
    ]
    assert [(x["vote_type"], x["votes"]) for x in row["totals"]] == [("For", 3), ("Against", 1)]
    assert [v["last_name"] for v in row["votes"]] == ["Friis", "Juhl", "Møller", "Dahl"]
    assert (whole[103]["votes"], whole[103]["totals"], whole[103]["party_votes"]) == ([], [], [])
    assert documents.ballot_document(t, 100).collect() == [row]

    member = documents.member_document(t, 1).first()
    assert [(x["vote_type"], x["votes"]) for x in member["stats"]] == [("For", 3), ("Absent", 1)]
    assert len(member["topic_stats"]) == 4
    assert documents.member_document(t, 5).first()["stats"] == []


def test_a_big_ballot_comes_in_parts(spark):
    members = [(i, "F", f"N{i}", "A", 1) for i in range(400)]
    votes = [(i, 100, i % 400, 1 + i % 3) for i in range(1000)] + [(2000, 101, 1, 1)]
    t = frames(spark, member=members, vote=votes)
    parts = documents.ballot_document(t, votes_per_part=90).where("ballot_id = 100").collect()
    assert {r["parts"] for r in parts} == {12}
    assert sorted(r["part"] for r in parts) == list(range(1, 13))
    got = sorted((v["member_id"], v["vote_type_id"]) for r in parts for v in r["votes"])
    assert got == sorted((m, v) for _, b, m, v in votes if b == 100)
    assert max(len(r["votes"]) for r in parts) < 200
    first = next(r for r in parts if r["part"] == 1)
    assert first["number"] is not None and sum(c["votes"] for c in first["totals"]) == len(got)
    assert sum(c["votes"] for c in first["party_votes"]) == len(got)
    others = [r for r in parts if r["part"] > 1]
    assert all(r["number"] is None and r["totals"] == [] and r["party_votes"] == [] for r in others)
    whole = documents.ballot_document(t, votes_per_part=90).where("ballot_id = 101").collect()
    assert [(r["part"], r["parts"], len(r["votes"])) for r in whole] == [(1, 1, 1)]


def test_without_broadcasts(spark):
    """The shuffled ways give the same rows."""
    def answers():
        t = frames(spark)
        return [sorted(map(str, df.collect())) for df in (
            ballot_list(t), ballot_header(t), ballot_party_votes(t), ballot_votes(t),
            member_topic_stats(t), member_votes(t), voting_members(t), documents.ballot_document(t),
        )]

    before = answers()
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for threshold in thresholds:
        spark.conf.set(threshold, -1)
    try:
        assert answers() == before
    finally:
        for threshold in thresholds:
            spark.conf.unset(threshold)


def test_fixture_is_not_trivial():
    assert len(ROWS["vote"]) == 10
