"""Pages far down, documents from buckets, and reports of an append."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frames import ROWS, frames, rows
from tellers import bindings as b
from tellers.operators import paging
from tellers.operators.bitmaps import id_bitmaps
from tellers.operators.paging import Page, far_page, rows_around, take_page
from tellers.plans import documents, quality
from tellers.plans.breakdowns import ballot_totals
from tellers.plans.ballots import order_columns
from tellers.schema import TABLES
from tellers.session import cut, local_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def listed(spark):
    draw = random.Random(2)
    made = [(n, draw.choice([None, "a", "b", "same", "same", "same", f"t{n % 97}"])) for n in range(3000)]
    return cut(spark.createDataFrame(made, "id bigint, title string"))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_number_are_those_of_the_sorted_list(listed, direction, monkeypatch):
    monkeypatch.setattr(paging, "SAMPLED", 64)
    order = [("title", direction), ("id", "asc")]
    for page in (Page(1, 7), Page(2, 50), Page(30, 50), Page(60, 50), Page(61, 50), Page(1, 5000), Page(429, 7)):
        want = rows(take_page(listed, order_columns(order), page), "id")
        assert rows(far_page(listed, order, page, rows_at_once=40), "id") == want


def test_only_the_range_of_the_page_is_sorted(listed):
    part, begin = rows_around(listed, [("title", "asc"), ("id", "asc")], 2500, 10, rows_at_once=60)
    assert part.count() <= 200 and begin <= 2500
    assert begin + part.count() >= 2510


def test_a_list_of_equal_values_is_divided_by_its_id(spark):
    same = cut(spark.range(5000).selectExpr("id", "'x' AS title"))
    part, begin = rows_around(same, [("title", "desc"), ("id", "asc")], 4000, 10, rows_at_once=50)
    assert part.count() <= 200
    assert rows(far_page(same, [("title", "desc"), ("id", "asc")], Page(401, 10), 50), "id") == [(n,) for n in range(4000, 4010)]
    assert far_page(same.limit(0), [("title", "asc"), ("id", "asc")], Page(3), 50).count() == 0


def ancestors(plan: str, wanted: str) -> list[list[str]]:
    """The nodes above each line of a plan that holds ``wanted``."""
    above, out = [], []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        above = [a for a in above if a[0] < depth]
        if wanted in line:
            out.append([n for _, n in above])
        above.append((depth, name))
    return out


def test_documents_from_buckets_read_the_votes_once_and_move_none(spark, tmp_path):
    source = b.Source(spark, FOLDER)
    votes = documents.in_buckets(b.vote(source), "ballot_id", str(tmp_path))
    ballots = documents.in_buckets(b.ballot(source), "id", str(tmp_path))
    found = documents.bucketed_ballot_document(b.tables(source, vote=votes, ballot=ballots))
    text = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line and "member_id" in line]
    assert len(scans) == 1
    [above] = ancestors(text, scans[0].strip())
    assert not [node for node in above if node.startswith("Exchange")]


@pytest.mark.parametrize("size", [3, documents.VOTES_PER_PART])
def test_documents_move_each_vote_once_and_no_name(spark, size):
    found = documents.ballot_document(b.tables(b.Source(spark, FOLDER)), votes_per_part=size)
    text = found._jdf.queryExecution().executedPlan().toString()
    [scan] = [line for line in text.splitlines() if "FileScan" in line and "l_suppkey" in line]
    [above] = ancestors(text, scan.strip())
    assert len([node for node in above if node.startswith("Exchange")]) == 1
    joins = [n for n, node in enumerate(above) if "Join" in node and "member_id" in node]
    assert joins and joins[0] < next(n for n, node in enumerate(above) if node.startswith("Exchange"))


def told(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, 60])
def test_ballots_too_large_to_gather_give_the_same_parts(spark, size, monkeypatch):
    draw = random.Random(7)
    votes = [
        (n, draw.choice([100] * 9 + [101, 102, 103, 999, None]), draw.choice([1, 2, 3, 4, 5, 77, None]), draw.choice([1, 2, 3, 7, None]))
        for n in range(300)
    ]
    t = frames(spark, vote=votes)
    want = told(documents.ballot_document(t, votes_per_part=size))
    monkeypatch.setattr(documents, "GATHERED", 20)
    assert told(documents.ballot_document(t, votes_per_part=size)) == want


def test_votes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(documents, "VOTES_PER_TASK", 500)
    found = documents.ballot_document(b.tables(b.Source(spark, FOLDER)), votes_per_part=3)
    text = found._jdf.queryExecution().executedPlan().toString()
    rows = b.Source(spark, FOLDER).lineitem.count()
    by_number = f"{rows // 500 + 1}), REPARTITION_BY_NUM"
    assert text.count(by_number) == 2  # the votes and what they are joined to


def test_totals_of_ballots_from_buckets_move_no_vote(spark, tmp_path):
    source = b.Source(spark, FOLDER)
    votes = documents.in_buckets(b.vote(source), "ballot_id", str(tmp_path))
    t = b.tables(source, vote=votes)
    text = ballot_totals(t)._jdf.queryExecution().executedPlan().toString()
    [scan] = [line for line in text.splitlines() if "FileScan" in line and "vote_type_id" in line]
    [above] = ancestors(text, scan.strip())
    assert not [node for node in above if node.startswith("Exchange")]
    assert sorted(rows(ballot_totals(t))) == sorted(rows(ballot_totals(b.tables(source))))


def test_documents_from_buckets_in_parts(spark, tmp_path):
    t = frames(spark)
    made = t.replaced(
        vote=documents.in_buckets(t["vote"], "ballot_id", str(tmp_path)), ballot=documents.in_buckets(t["ballot"], "id", str(tmp_path))
    )
    for size in (1, 2, 3, 100):
        got = {(r["ballot_id"], r["part"]): r.asDict(recursive=True) for r in documents.bucketed_ballot_document(made, size).collect()}
        want = {(r["ballot_id"], r["part"]): r.asDict(recursive=True) for r in documents.ballot_document(t, votes_per_part=size).collect()}
        heads = {k: v for k, v in got.items() if k[1] == 1}
        for key, whole in ((k, v) for k, v in want.items() if k[1] == 1):
            kept = {c: v for c, v in heads[key].items() if c != "votes"}
            assert kept == {c: v for c, v in whole.items() if c != "votes"}
        for ballot in {k[0] for k in want}:
            votes = [sorted(str(v) for k, r in rows_.items() if k[0] == ballot for v in r["votes"]) for rows_ in (got, want)]
            assert votes[0] == votes[1]
            assert all(len(r["votes"]) <= size and (k[1] == 1 or r["held_at"] is None) for k, r in got.items() if k[0] == ballot)


def test_a_report_of_an_append_is_that_of_the_whole(spark):
    new = [(11, 100, 1, 1), (1, 100, 2, 1), (1, 100, 2, 1), (12, 999, 1, 1), (13, 100, None, 1), (14, 101, 77, 5), (14, 101, 1, 1), (None, None, 1, None)]
    clean = [r for r in ROWS["vote"] if r[1] in (100, 101) and r[2] < 6 and r[3] < 4]
    t = frames(spark, vote=clean + new)
    fresh = local_rows(spark, new, TABLES["vote"])
    known = {name: id_bitmaps(t[name]) for name in ("ballot", "member", "vote_type")}
    found = quality.append_report("vote", fresh, id_bitmaps(local_rows(spark, clean, TABLES["vote"])), known)
    assert sorted(rows(found)) == sorted(rows(quality.constraint_report(t, ["vote"])))
    assert quality.constraint_report(frames(spark, vote=clean), ["vote"]).where(F.col("violations") > 0).isEmpty()
