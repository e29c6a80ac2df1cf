"""Search through the index, counts that are kept, and calls at a pace."""

from __future__ import annotations

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from frames import DAY, ROWS, frames, rows
from tellers.plans import counts, labelling, loading
from tellers.plans.ballots import BallotFilter, ballot_list, ballot_page_info, ballots_sorted, filtered_ballots
from tellers.plans.jobs import LabelJob
from tellers.plans.member_votes import VoteFilter, member_votes, member_votes_page, member_votes_page_info
from tellers.plans.members import member_search, member_stats, member_topic_stats
from tellers.plans.search import BILL_FIELDS, MEMBER_FIELDS, RANGE, candidates, gram_index, needle_grams, search
from tellers.plans.tables import Tables
from tellers.schema import TABLES
from tellers.session import cut, local_rows
from tellers.sources import store as stored
from tellers.sources.store import Store


def test_runs_of_a_needle_end_at_wildcards():
    assert needle_grams("ABcd") == ["abc", "bcd"]
    assert needle_grams("ab%cde_fgØ") == ["cde", "fgØ"]
    assert needle_grams("ab_cd%e") == [] and needle_grams("") == []


@pytest.fixture(scope="module")
def bills(spark):
    draw = random.Random(4)
    words = ["Miljø", "MILJØ", "a_b", "100%", "tax", "Taxes", "å", "", "back\\slash", "x" * 50, "aaa", "aaaa"]
    made = []
    for n in range(300):
        title = " ".join(draw.choices(words, k=draw.randrange(4)))
        made.append((n * 700 - 1000, title if n % 9 else None, draw.choice([None, "short tax", "b"]), None, f"L {n}", 1, 1))
    return cut(local_rows(spark, made, TABLES["bill"]))


@pytest.mark.parametrize("needle", ["tax", "TAX ", "miljø", "Ø 1", "l 1_", "100%", "a_b", "aaaa", "k\\s", "ab", "%", "xxx" * 5, "no such", "short tax"])
def test_the_index_finds_what_a_scan_finds(spark, bills, needle):
    halves = [gram_index(bills.where(f"pmod(id, 2) = {n}"), BILL_FIELDS) for n in (0, 1)]
    index = halves[0].unionByName(halves[1])
    assert sorted(rows(search(bills, needle, BILL_FIELDS, index), "id")) == sorted(rows(search(bills, needle, BILL_FIELDS), "id"))
    found = candidates(index, needle, list(BILL_FIELDS))
    assert (found is None) == (not needle_grams(needle))


def test_more_candidates_than_are_listed_are_joined(spark, bills, monkeypatch):
    from tellers.plans import search as module

    want = sorted(rows(search(bills, "tax", BILL_FIELDS), "id"))
    monkeypatch.setattr(module, "LISTED", 3)
    index = gram_index(bills, BILL_FIELDS)
    assert sorted(rows(search(bills, "tax", BILL_FIELDS, index), "id")) == want and len(want) > 3


def test_a_run_that_all_rows_hold_is_split_by_ranges(spark):
    many = spark.range(5 * RANGE).selectExpr("id", "'same text' AS title", "NULL AS short_title", "NULL AS number")
    sizes = gram_index(many, {"title": "title"}).selectExpr("range", "size(places) AS n").collect()
    assert {r["n"] for r in sizes} == {RANGE} and len(sizes) == 5 * len(needle_grams("same text"))


def test_titles_of_others_are_not_read(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path))
    monkeypatch.setattr(stored, "LOOKUPS", {"bill": ("id",)})
    monkeypatch.setattr(stored, "ROW_GROUP_BYTES", 16 * 1024)
    many = spark.range(100_000).selectExpr(
        "id", "IF(id = 77777, 'the needle', md5(CAST(id AS STRING))) AS title", "CAST(NULL AS STRING) AS short_title",
        "CAST(NULL AS STRING) AS resume", "CAST(id AS STRING) AS number", "1L AS type_id", "1L AS period_id")
    store.write("bill", many)
    store.append(bill_gram=gram_index(store.read("bill").where("id BETWEEN 70000 AND 80000"), BILL_FIELDS))
    found = search(store.read("bill"), "needle", BILL_FIELDS, store.read("bill_gram"))
    assert rows(found, "id") == [(77777,)]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 20_000


def test_lists_through_the_index(spark):
    t = frames(spark)
    bill_index, member_index = gram_index(t["bill"], BILL_FIELDS), gram_index(t["member"], MEMBER_FIELDS)
    for text in ("miljø", "iljØ 1", "L 1", "zzz", "a\\b"):
        f = BallotFilter(text=text)
        assert sorted(rows(filtered_ballots(t, f, bill_index), "id")) == sorted(rows(filtered_ballots(t, f), "id"))
        assert sorted(rows(ballot_list(t, f, bill_index), "id")) == sorted(rows(ballot_list(t, f), "id"))
        assert rows(ballot_page_info(t, f, index=bill_index)) == rows(ballot_page_info(t, f))
        assert rows(ballots_sorted(t, f, index=bill_index), "id") == rows(ballots_sorted(t, f), "id")
        v = VoteFilter(text=text)
        assert rows(member_votes_page(t, v, index=bill_index)) == rows(member_votes_page(t, v))
        assert sorted(rows(member_votes_page_info(t, v, index=bill_index))) == sorted(rows(member_votes_page_info(t, v)))
        assert sorted(rows(member_votes(t, v, index=bill_index), "vote_id")) == sorted(rows(member_votes(t, v), "vote_id"))
    for text in ("Åse", "Bo Dahl", "jær", "o d", "B"):
        assert rows(member_search(t, text, index=member_index), "id") == rows(member_search(t, text), "id")


def test_a_load_keeps_the_index_and_the_counts(spark, tmp_path):
    from test_jobs import FEED, land

    for kind, records in FEED.items():
        land(tmp_path / "feed" / kind, records)
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, {k: str(tmp_path / "feed" / k) for k in FEED})
    load.run()
    load.votes()
    t = Tables.of_store(store, TABLES)
    assert rows(search(t["bill"], "L 1", BILL_FIELDS, store.read("bill_gram")), "id") == [(50,)]
    assert sorted(rows(counts.kept_member_stats(t, store.read("member_bill_votes")))) == sorted(rows(member_stats(t)))
    answer = json.dumps([{"sag_id": 50, "kategorier": ["Energi", "Bolig"]}])
    LabelJob(store, lambda prompt: answer, tasks=1).run()
    t = Tables.of_store(store, TABLES)
    want = sorted(rows(member_topic_stats(t)))
    assert len(want) == 4 and sorted(rows(counts.kept_member_topic_stats(t, store.read("member_topic_votes")))) == want


def test_counts_follow_votes_and_labels(spark):
    draw = random.Random(9)
    label_sets = [[(b, k) for b in (10, 11, 12, None) for k in (1, 2, 3) if draw.random() < 0.5] for _ in range(4)]
    label_sets[1] += label_sets[1][:2]  # a repeated label counts once
    parts = [ROWS["vote"][:4], ROWS["vote"][4:6], [], ROWS["vote"][6:]]
    t = frames(spark)
    by_bill = by_topic = None
    before = local_rows(spark, [], TABLES["bill_topic"])
    for votes, labels in zip(parts, label_sets):
        new = cut(counts.bill_changes(local_rows(spark, votes, TABLES["vote"]), t["ballot"]))
        by_bill = new if by_bill is None else by_bill.unionByName(new)
        after = local_rows(spark, labels, TABLES["bill_topic"])
        changes = counts.topic_changes(new, before).unionByName(counts.relabelled(by_bill, before, after))
        by_topic = cut(changes if by_topic is None else by_topic.unionByName(changes))
        before = after
    whole = frames(spark, bill_topic=label_sets[-1])
    assert sorted(rows(counts.kept_member_stats(whole, by_bill))) == sorted(rows(member_stats(whole)))
    assert sorted(rows(counts.kept_member_topic_stats(whole, by_topic))) == sorted(rows(member_topic_stats(whole)))
    assert rows(counts.kept_member_stats(whole, by_bill, 1)) == rows(member_stats(whole, 1))
    assert DAY is not None


def test_a_call_is_tried_again_and_waits_longer_each_time(monkeypatch):
    waits = []
    monkeypatch.setattr(labelling.time, "sleep", waits.append)
    answers = iter([ValueError("one"), ValueError("two"), "yes"])

    def ask(prompt):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    assert labelling._Caller(ask, labelling.Pace(tries=3, first_wait=2, longest_wait=3))("p") == ("yes", None)
    assert waits == [2, 3]
    broken = labelling._Caller(lambda p: 1 / 0, labelling.Pace(tries=2, first_wait=1))
    assert broken("p") == (None, "division by zero")
    for wrong in ({"at_once": 0}, {"tries": 0}, {"per_second": 0}):
        with pytest.raises(ValueError):
            labelling.Pace(**wrong)


def test_calls_keep_their_rate_and_run_side_by_side(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "batch BIGINT, prompt STRING")

    def ask(prompt):
        start = time.monotonic()
        time.sleep(0.5)
        return f"{start}"

    def starts(pace):
        asked = labelling.label_batches(prompts, ask, tasks=1, pace=pace).collect()
        assert all(r["error"] is None for r in asked)
        return sorted(float(r["response"]) for r in asked)

    paced = starts(labelling.Pace(per_second=5, at_once=6))
    assert all(b - a >= 0.19 for a, b in itertools.pairwise(paced)) and paced[-1] - paced[0] < 2
    together = starts(labelling.Pace(at_once=6))
    assert together[-1] - together[0] < 0.4


def test_open_prompts_are_found_once(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "s"))
    bills = [(n, f"t{n}", None, None, None, 1, 1) for n in range(1, 100)]
    store.write("bill", local_rows(spark, bills, TABLES["bill"]))
    store.write("topic", local_rows(spark, [(1, "Energi")], TABLES["topic"]))
    found = []
    real = LabelJob._unanswered
    monkeypatch.setattr(LabelJob, "_unanswered", lambda job: found.append(1) or real(job))
    job = LabelJob(store, lambda prompt: "[]", tasks=2, batches_per_commit=2)
    job.prompts()
    job.ask_all()
    assert found == [1] and store.read("response").count() == 7
    assert sorted(r["batch"] for r in store.read("response").collect()) == list(range(7))
    assert store.read("response").where(F.col("response") != "[]").isEmpty()
