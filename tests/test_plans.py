"""Physical plans: what is pruned, pushed down, broadcast, and sorted."""

from __future__ import annotations

import re

import pytest

from tellers import bindings as b
from tellers import registry
from tellers.operators.keyed import latest
from tellers.operators.paging import Page, take_page
from tellers.plans import lookups
from tellers.plans.ballots import BallotFilter, filtered_ballots, list_order, order_columns
from tellers.plans.breakdowns import ballot_party_votes, ballot_totals, ballot_votes
from tellers.sources.store import laid_out
from tellers.plans.members import member_stats, member_topic_stats

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def t(spark):
    return b.tables(b.Source(spark, FOLDER))


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and f"{table}.parquet" in line]


def test_page_is_a_top_k(t):
    rows = take_page(filtered_ballots(t, BallotFilter()), order_columns(list_order(None, None)), Page(3))
    text = plan(rows)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_filters_reach_the_scan(t):
    f = BallotFilter(date_from="1996-01-01", date_to="1996-12-31")
    pushed = scans(plan(filtered_ballots(t, f)), "orders")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    one = scans(plan(ballot_totals(t, 7)), "lineitem")[0]
    assert "EqualTo(l_orderkey,7)" in one


def test_scans_read_only_what_they_need(t):
    read = re.search(r"ReadSchema: struct<([^>]*)>", scans(plan(member_stats(t)), "lineitem")[0])
    assert {c.split(":")[0] for c in read.group(1).split(",")} == {"l_suppkey", "l_returnflag"}


def test_votes_are_shuffled_once_or_not_at_all(t):
    assert "hashpartitioning(ballot_id" not in plan(ballot_votes(t)).replace("l_orderkey", "")
    assert plan(ballot_votes(t)).count("Exchange hashpartitioning") == 0
    # one shuffle of partial counts
    assert plan(ballot_party_votes(t)).count("Exchange hashpartitioning") == 1


def test_topic_statistics_scan_the_votes_once(t):
    assert len(scans(plan(member_topic_stats(t)), "lineitem")) == 1


def test_last_wins_is_cut_down_before_the_shuffle(t):
    text = plan(latest(t["vote"], ["ballot_id"], ["id"]))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_stored_votes_are_clustered(t):
    text = plan(laid_out(t["vote"], "vote"))
    assert "rangepartitioning(ballot_id" in text.replace("l_orderkey", "ballot_id")
    assert re.search(r"Sort \[ballot_id\S* ASC NULLS FIRST, member_id\S* ASC NULLS FIRST\], false", text)


def test_prompts_are_not_sorted_twice(spark):
    text = plan(registry.queries()["prompt_batches"](spark, FOLDER))
    assert "rangepartitioning" not in text


def test_voters_are_distinct_before_the_join(t):
    text = plan(lookups.members_who_voted(t))
    assert "LeftSemi" in text and text.count("HashAggregate") == 2


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_window_runs_over_a_whole_table(spark, name):
    """Windows are partitioned, but for the one over the few bucket sizes."""
    text = plan(registry.queries()[name](spark, FOLDER))
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            partitioned = line.count("], [") == 2  # partition and order columns
            assert partitioned or "_bucket" in line, line
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
