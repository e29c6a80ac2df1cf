"""Partition-wise writes, unfinished changes, sets of ids, and streams of pages and votes."""

from __future__ import annotations

import json
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import rows
from tellers.operators.bitmaps import count_ids, id_bitmaps, ids_among, merged_bitmaps
from tellers.plans import build, loading
from tellers.schema import RECORDS, TABLES
from tellers.session import local_rows
from tellers.sources import store as stored
from tellers.sources.landed import read_pages, stream_pages
from tellers.sources.store import PART, Store
from tellers.streaming import pages, votes
from test_faults import PAGES
from test_jobs import FEED, land


def files(folder):
    """Files of a table by partition, with the time of their last change."""
    out = {}
    for path, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(path), set()).add((name, os.stat(f"{path}/{name}").st_mtime_ns))
    return out


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "store"))


def parties(spark, *ids, name="x"):
    return local_rows(spark, [(i, "A", name) for i in ids], TABLES["party"])


def test_an_upsert_writes_the_partitions_it_names_and_no_others(spark, store, monkeypatch):
    monkeypatch.setitem(stored.RANGES, "party", ("id", 100))
    store.write("party", parties(spark, *range(0, 1000, 7)))
    before = files(f"{store.root}/party")
    assert len(before) == 10
    assert store.upsert("party", parties(spark, 301, 301, name="new"), ["name"]) == 1
    after = files(f"{store.root}/party")
    assert {p for p in after if after[p] != before.get(p)} == {f"{PART}=3"}
    assert store.upsert("party", parties(spark, 7, 5000, -3, None, name="new"), ["name"]) == 3
    found = {r["id"]: r["name"] for r in store.read("party").collect()}
    assert len(found) == 143 + 3 and {i for i, n in found.items() if n == "new"} == {301, 7, 5000, None, -3}


def test_the_rows_of_an_upsert_are_those_of_the_whole_table_put_in(spark, store, monkeypatch):
    monkeypatch.setitem(stored.RANGES, "party", ("id", 5))
    state = {}
    for n in range(4):
        batch = [(i, f"{n}{i % 3}", f"n{j}") for j, i in enumerate([n, n + 3, n * 5, 12, 12])]
        store.upsert("party", local_rows(spark, batch, TABLES["party"]), ["name"])
        for i, abbreviation, name in sorted(batch, key=lambda r: r[2]):
            state[i] = (i, abbreviation, name)
    assert sorted(rows(store.read("party"))) == sorted(state.values())


def test_only_a_newer_row_replaces_with_newest(spark, store):
    at = lambda n: ((None, None, None, n), 0)
    vote = lambda i, kind, n: (i, 100, 1, kind, at(n))
    schema = TABLES["streamed_vote"]
    order = ["arrival"]
    first = spark.createDataFrame([vote(1, 3, 5), vote(2, 1, 5)], schema)
    store.upsert("streamed_vote", first, order, newest=True)
    store.upsert("streamed_vote", spark.createDataFrame([vote(1, 9, 4), vote(2, 0, 6)], schema), order, newest=True)
    assert sorted(rows(store.read("streamed_vote"), "id", "vote_type_id")) == [(1, 3), (2, 0)]


def test_a_change_that_stopped_is_finished_once(spark, store, monkeypatch):
    store.append(topic=local_rows(spark, [(1, "a")], TABLES["topic"]))
    real, calls = stored._overwrite_partitions, []

    def stopping(df, path, by, table="", whole=False):
        if table == "bill_topic" and not calls:
            calls.append(1)
            raise RuntimeError("stopped")
        real(df, path, by, table, whole)

    monkeypatch.setattr(stored, "_overwrite_partitions", stopping)
    with pytest.raises(RuntimeError):
        store.append(
            topic=local_rows(spark, [(2, "b")], TABLES["topic"]), bill_topic=local_rows(spark, [(5, 2)], TABLES["bill_topic"])
        )
    store.append(party=local_rows(spark, [(3, "A", "x")], TABLES["party"]))  # after what was left half done
    assert rows(store.read("bill_topic")) == [(5, 2)]
    again = Store.create(spark, store.root)
    for _ in range(2):
        assert sorted(rows(again.read("topic"))) == [(1, "a"), (2, "b")] and rows(again.read("bill_topic")) == [(5, 2)]
        again.finish()
    assert os.listdir(f"{store.root}/_staged") == []


def test_progress_has_one_value_a_key_whoever_writes(spark, store):
    other = Store(spark, store.root)
    for n in range(3):
        store.set_progress(step=n, **{"a:b/c": "x"})
        other.set_progress(step=n + 10)
    assert store.progress("step") == other.progress("step") == "12" and store.progress("a:b/c") == "x"
    assert store.progress("none") is None
    assert sum(len(f) for f in files(f"{store.root}/progress").values()) == len(os.listdir(f"{store.root}/progress")) - sum(
        not n.startswith("key=") for n in os.listdir(f"{store.root}/progress"))


# ---- sets of ids


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(-100_000, 10**12), max_size=20), min_size=1, max_size=3))
def test_sets_of_ids_merge_and_answer(spark, batches):
    sets = [id_bitmaps(spark.createDataFrame([(i,) for i in b] + [(None,)], "id bigint")) for b in batches]
    merged = sets[0]
    for other in sets[1:]:
        merged = merged.unionByName(other)
    every = {i for b in batches for i in b}
    assert count_ids(merged).first()[0] == len(every)
    asked = sorted(every | {i + 1 for i in every} | {0})
    held = ids_among(spark.createDataFrame([(i,) for i in [*asked, asked[0], None]], "x bigint"), merged_bitmaps(merged))
    assert sorted(r["x"] for r in held.collect()) == sorted(every)


def test_an_increment_does_not_read_the_stored_votes(spark, store):
    kind = TABLES["vote"]
    store.write("ballot", spark.range(100, 140).selectExpr(
        "id", "id AS number", "'' AS conclusion", "true AS passed", "'' AS comment",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS held_at", "1L AS type_id", "1L AS bill_id"))
    store.write("member", local_rows(spark, [(1, "a", "b", "A", 1)], TABLES["member"]))
    store.write("vote_type", local_rows(spark, [(1, "For")], TABLES["vote_type"]))
    loading.append_votes(store, local_rows(spark, [(1, 100, 1, 1), (2, 101, 9, 1), (8, 7, 1, 1)], kind))
    landed = local_rows(spark, [(3, 100, 1, 1), (4, 101, 1, 1), (5, 102, 1, 1), (5, 102, 1, 0), (6, None, 1, 1)], kind)
    wanted = loading.votes_to_add(store.read("loaded_ballot"), landed)
    assert sorted(rows(wanted), key=str) == [(5, 102, 1, 1), (6, None, 1, 1)]
    assert {f.split("/store/")[1].split("/")[0] for f in wanted.inputFiles()} == {"loaded_ballot"}
    before = files(f"{store.root}/vote")
    loading.append_votes(store, landed)
    assert sorted(rows(store.read("vote"))) == [(1, 100, 1, 1), (5, 102, 1, 1)]
    assert rows(store.read("rejected_vote"), "id") == [(2,)]
    assert all(files(f"{store.root}/vote")[p] == f for p, f in before.items())


def test_steps_leave_no_parsed_pages(spark, tmp_path):
    from tellers.session import shared_folder

    for kind, records in FEED.items():
        land(tmp_path / "feed" / kind, records)
    held = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    loading.Load(Store.create(spark, str(tmp_path / "s")), {k: str(tmp_path / "feed" / k) for k in FEED}).run()
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == held


# ---- streams


def landing(spark, tmp_path, kind="ballot_type"):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(files_per_trigger=1):
        pages.land(spark, str(tmp_path / "feed"), RECORDS[kind], out, state, files_per_trigger=files_per_trigger).awaitTermination()
        return pages.completeness_so_far(spark, out).first().asDict()

    return out, run


def write_lines(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines), encoding="utf-8")


def test_a_stream_sets_damaged_pages_aside_and_counts(spark, tmp_path):
    out, run = landing(spark, tmp_path)
    feed = tmp_path / "feed"
    write_lines(feed, "a.json", PAGES[0], PAGES[1])
    write_lines(feed, "b.json", PAGES[0])  # the same records again
    first = run()
    assert first == {"pages": 3, "damaged": 1, "declared": 4, "records": 2, "complete": False}
    assert run() == first
    write_lines(feed, "c.json", *PAGES[2:], '{"odata.count": "4", "value": [{"id": 3, "type": "c"}, {"id": 40000, "type": "d"}]}')
    assert run() == {"pages": 7, "damaged": 4, "declared": 4, "records": 4, "complete": False}
    assert sorted(rows(pages.rejected_so_far(spark, out))) == sorted((p,) for p in PAGES[1:])
    stored_records = spark.read.parquet(f"{out}/records")
    assert sorted(set(rows(stored_records, "id"))) == [(1,), (2,), (3,), (40000,)]


def test_a_whole_feed_is_reported_complete(spark, tmp_path):
    _, run = landing(spark, tmp_path)
    land(tmp_path / "feed", FEED["ballot_type"], page=1)
    assert run()["complete"] is True


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch):
    out, run = landing(spark, tmp_path)
    write_lines(tmp_path / "feed", "a.json", *PAGES)
    real, calls = pages.id_bitmaps, []

    def stopping(*args):
        if not calls:
            calls.append(1)
            raise RuntimeError("stopped")
        return real(*args)

    monkeypatch.setattr(pages, "id_bitmaps", stopping)
    with pytest.raises(Exception, match="stopped"):
        run()
    assert run() == {"pages": 5, "damaged": 4, "declared": 4, "records": 2, "complete": False}
    assert spark.read.parquet(f"{out}/rejected").count() == 4


def test_an_unguarded_stream_stops_at_a_damaged_page(spark, tmp_path):
    write_lines(tmp_path / "feed", "a.json", PAGES[0], PAGES[1])
    records = stream_pages(spark, str(tmp_path / "feed"), RECORDS["ballot_type"])
    query = records.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="damaged page"):
        query.awaitTermination()


def vote_page(*records):
    fields = ("id", "afstemningid", "aktørid", "typeid")
    return json.dumps({"odata.count": "9", "value": [dict(zip(fields, r)) for r in records]})


def test_the_last_fetched_vote_wins_in_a_batch_and_in_a_later_one(spark, tmp_path):
    feed, out, log = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        pages.land(spark, str(feed), RECORDS["vote"], out, str(tmp_path / "s1")).awaitTermination()
        stream = build.build_votes(pages.record_stream(spark, out, RECORDS["vote"]))
        votes.stream_votes(stream, log, str(tmp_path / "s2")).awaitTermination()
        return sorted(rows(votes.read_log(spark, log, TABLES["vote"])))

    write_lines(feed, "a.json", vote_page((1, 100, 1, 9), (2, 100, 2, 9), (1, 100, 1, 8)), vote_page((2, 100, 2, 7), (3, 100, 3, 1)))
    os.utime(feed / "a.json", (2_000_000, 2_000_000))
    assert run() == [(1, 100, 1, 8), (2, 100, 2, 7), (3, 100, 3, 1)]  # smaller, and later in the batch
    write_lines(feed, "b.json", vote_page((1, 100, 1, 2), (3, 100, 3, 5)))
    os.utime(feed / "b.json", (3_000_000, 3_000_000))
    want = [(1, 100, 1, 2), (2, 100, 2, 7), (3, 100, 3, 5)]  # smaller, in a later batch
    assert run() == want
    write_lines(feed, "c.json", vote_page((1, 100, 1, 6)))
    os.utime(feed / "c.json", (1_000_000, 1_000_000))  # an older file that is found late
    assert run() == want and run() == want
    whole = read_pages(spark, str(feed), RECORDS["vote"])
    assert sorted(rows(loading.remaining_votes(spark.createDataFrame([], "b bigint"), build.build_votes(whole)), "id", "vote_type_id")) == [
        (i, t) for i, _, _, t in want]
    store = Store.create(spark, str(tmp_path / "store"))
    assert votes.fold_log(store, log) > 0 and votes.fold_log(store, log) == 0
    assert sorted(rows(store.read("streamed_vote").drop("arrival"))) == want


def test_folding_in_steps_is_folding_at_once(spark, tmp_path):
    log = str(tmp_path / "log")
    kind = TABLES["vote"]
    once, steps = Store.create(spark, str(tmp_path / "a")), Store.create(spark, str(tmp_path / "b"))
    for batch, kinds in enumerate([(3, 1), (1, 2), (2, 2)]):  # without an arrival the later batch counts
        local_rows(spark, [(i, 100, i, k) for i, k in enumerate(kinds)], kind).write.parquet(f"{log}/batch={batch}")
        votes.fold_log(steps, log)
    votes.fold_log(once, log)
    want = sorted(rows(votes.read_log(spark, log, kind)))
    assert want == [(0, 100, 0, 2), (1, 100, 1, 2)]
    for s in (once, steps):
        assert sorted(rows(s.read("streamed_vote").drop("arrival"))) == want


def test_state_is_let_go_with_the_watermark(spark, tmp_path):
    feed, out, log, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "s2")
    held = []
    for n in range(4):
        write_lines(feed, f"{n}.json", vote_page(*[(100 * n + i, 1, i, 1) for i in range(50)]))
        pages.land(spark, str(feed), RECORDS["vote"], out, str(tmp_path / "s1")).awaitTermination()
        stream = build.build_votes(pages.record_stream(spark, out, RECORDS["vote"]))
        query = votes.stream_votes(stream, log, state, state_for="1 second")
        query.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
        time.sleep(2.1)
    assert max(held) <= 100
    assert votes.read_log(spark, log, TABLES["vote"]).agg(F.count_distinct("id")).first()[0] == 200
