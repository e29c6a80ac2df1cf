"""Feeds with repeats, damage and unknown references; stops; and wrong folders."""

from __future__ import annotations

import json
import os
import types

import pytest
from pyspark.sql import functions as F

from frames import rows
from tellers import session
from tellers.plans import build, labelling, loading, repair
from tellers.plans.jobs import LabelJob, RepairJob, store_log
from tellers.schema import RECORDS, TABLES
from tellers.session import cut, local_rows, remove_cuts
from tellers.sources import store as stored
from tellers.sources.landed import completeness, explode_pages, read_pages, rejected_pages, stream_pages
from tellers.sources.store import Store
from tellers.streaming.votes import stream_votes
from test_jobs import FEED, land

PAGES = [
    '{"odata.count": "4", "value": [{"id": 1, "type": "a"}, {"id": 2, "type": "b"}]}',
    '{"odata.count": "4", "value": [{"id": 3, "type": "c"}, {"id": 4, "ty',
    '{"odata.count": "4", "value": [{"id": "x", "type": "d"}]}',
    "not json", '{"odata.count": "4"}',
]


def test_damaged_pages_are_set_aside_whole(spark):
    pages = spark.createDataFrame([(p,) for p in PAGES], "value STRING")
    kind = RECORDS["ballot_type"]
    assert sorted(rows(explode_pages(pages, kind))) == [(1, "a"), (2, "b")]
    assert sorted(r["value"] for r in rejected_pages(pages, kind).collect()) == sorted(PAGES[1:])
    seen = completeness(pages, kind).first()
    assert (seen["damaged"], seen["records"], seen["complete"]) == (4, 2, False)


def test_a_repeated_record_counts_once(spark):
    twice = spark.createDataFrame([(PAGES[0],), (PAGES[0],)], "value STRING")
    seen = completeness(twice, RECORDS["ballot_type"]).first()
    assert (seen["records"], seen["complete"]) == (2, False)


def test_the_last_to_arrive_wins_not_the_greatest(spark, tmp_path):
    land(tmp_path, [{"id": 1, "type": "Zold"}, {"id": 1, "type": "Mid"}], page=1, name="a.json")
    land(tmp_path, [{"id": 1, "type": "Between"}, {"id": 1, "type": "Anew"}], page=2, name="b.json")
    os.utime(tmp_path / "a.json", (1_000_000, 1_000_000))
    os.utime(tmp_path / "b.json", (2_000_000, 2_000_000))
    records = read_pages(spark, str(tmp_path), RECORDS["ballot_type"])
    target = local_rows(spark, [(2, "kept")], TABLES["ballot_type"])
    assert sorted(rows(loading.load_lookup(target, records))) == [(1, "Anew"), (2, "kept")]
    os.utime(tmp_path / "a.json", (3_000_000, 3_000_000))
    again = read_pages(spark, str(tmp_path), RECORDS["ballot_type"])
    assert sorted(rows(loading.load_lookup(target, again))) == [(1, "Mid"), (2, "kept")]


def test_repeats_do_not_multiply_what_they_repair(spark):
    bills = local_rows(spark, [(1, "t", None, None, "old", 1, 1)], TABLES["bill"])
    records = spark.createDataFrame([(1, "L 9", 1), (1, "L 2", 2)], "id BIGINT, nummer STRING, arrival INT")
    assert rows(repair.repair_numbers(bills, records), "id", "number") == [(1, "L 2")]
    assert rows(repair.numbered_bills(bills, records)) == [(1, 1)]
    members = local_rows(spark, [(1, "a", "b", "X", 7)], TABLES["member"])
    parsed = spark.createDataFrame(
        [(1, "Z", "Zed", 1), (1, "N", "New", 2)], "id BIGINT, short STRING, full STRING, arrival INT"
    )
    parties = local_rows(spark, [(5, "N", "New"), (6, "Z", "Zed")], TABLES["party"])
    assert rows(repair.repair_members(members, parsed, parties)) == [(1, "a", "b", "N", 5)]
    steps = spark.createDataFrame(
        [(1, "2099-01-01", 8, 1), (1, "2023-01-01T00:00:00", 9, 2)], "id BIGINT, dato STRING, sagid BIGINT, arrival INT"
    )
    ballots = spark.createDataFrame([json.dumps(FEED["ballot"][0])], "string").select(
        F.from_json("value", RECORDS["ballot"]).alias("r")
    ).select("r.*")
    built = build.build_ballots(ballots.union(ballots), steps)
    assert rows(built, "id", "bill_id") == [(100, 9)]


@pytest.fixture
def landed(tmp_path):
    feed = {**FEED, "vote": [*FEED["vote"], {"id": 6, "afstemningid": 102, "aktørid": 1, "typeid": 55}]}
    feed["ballot"] = [*FEED["ballot"], {"id": 107, "nummer": 8, "typeid": 9, "sagstrinid": 1}]
    for kind, records in feed.items():
        land(tmp_path / "feed" / kind, records)
    return {kind: str(tmp_path / "feed" / kind) for kind in feed}


def test_unknown_references_are_set_aside_once(spark, landed, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, landed)
    load.run()
    for _ in range(2):
        assert sorted(rows(store.read("rejected_vote"), "id", "reason")) == [(4, "member"), (6, "vote_type")]
        assert sorted(rows(store.read("vote"), "id")) == [(1,), (2,), (3,)]
        assert rows(store.read("rejected_ballot"), "id", "reason") == [(107, "ballot_type")]
        load.votes()


def test_a_ballot_of_rejected_votes_alone_is_done(spark, landed, tmp_path):
    land(tmp_path / "feed" / "vote", [{"id": 4, "afstemningid": 102, "aktørid": 99, "typeid": 1}])
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, landed)
    load.run()
    load.votes()
    assert store.read("vote").isEmpty() and store.read("rejected_vote").count() == 1


def test_a_short_or_damaged_feed_stops_the_load(spark, landed, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    folder = tmp_path / "feed" / "vote_type"
    with open(folder / "p1.json", "w", encoding="utf-8") as out:
        out.write(PAGES[1] + "\n")
    with pytest.raises(loading.ShortFeed):
        loading.Load(store, landed).run()
    assert rows(store.read("rejected_page")) == [("vote_type", PAGES[1])]
    assert store.progress(loading.LAST_STEP) is None
    os.truncate(folder / "p1.json", 0)
    loading.Load(store, landed).run()
    assert store.read("vote").count() == 3


def test_a_wrong_root_is_no_empty_store(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Store(spark, str(tmp_path / "nowhere")).read("vote")
    store = Store.create(spark, str(tmp_path / "store"))
    assert store.read("vote").isEmpty()
    again = Store.create(spark, str(tmp_path / "store"))
    again.set_progress(a="1")
    assert store.progress("a") == "1"


def test_a_cluster_needs_a_shared_folder():
    def at(master, folder=None, current=None):
        context = types.SimpleNamespace(
            master=master, getCheckpointDir=lambda: current, setCheckpointDir=lambda path: None
        )
        return types.SimpleNamespace(
            sparkContext=context, conf=types.SimpleNamespace(get=lambda name, default: folder)
        )

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_folder(at(master))
        assert session.shared_folder(at(master, "hdfs://x/tmp")) == "hdfs://x/tmp"
        assert session.shared_folder(at(master, "hdfs://x/tmp", "hdfs://x/tmp/1")) == "hdfs://x/tmp/1"
    assert session.shared_folder(at("local[4]")).startswith("/")


def test_cuts_can_be_removed(spark):
    kept, gone = cut(spark.range(3)), cut(spark.range(4))
    folders = [f.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for f in (kept, gone)]
    remove_cuts(gone)
    assert [os.path.exists(f) for f in folders] == [True, False] and kept.count() == 3


def test_calls_are_dealt_to_tasks(spark):
    prompts = spark.range(40).select(F.col("id").alias("batch"), F.lit("p").alias("prompt"))
    asked = labelling.label_batches(prompts.coalesce(1), lambda prompt: str(os.getpid()), tasks=6)
    assert asked.rdd.getNumPartitions() == 6
    assert asked.groupBy(F.spark_partition_id()).count().count() == 6


def test_prompts_can_show_whole_resumes(spark):
    bills = spark.createDataFrame([(1, "t", None, "r" * 900)], "id BIGINT, title STRING, short_title STRING, resume STRING")
    for length, shown in ((None, "r" * 900), (10, "r" * 10 + "..."), (300, "r" * 300 + "...")):
        [prompt] = rows(labelling.prompt_batches(bills, "", resume_length=length), "prompt")
        assert prompt[0] == f"1. [id=1] t\n   Resume: {shown}\n\n"


def labelled_store(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    bills = [(n, f"t{n}", None, None, None, 1, 1) for n in range(1, 41)]
    store.write("bill", local_rows(spark, bills, TABLES["bill"]))
    store.write("topic", local_rows(spark, [(1, "Energi"), (2, "Bolig")], TABLES["topic"]))
    store.write("bill_topic", local_rows(spark, [(40, 2)], TABLES["bill_topic"]))
    return store


def test_labelling_asks_again_only_for_what_has_no_answer(spark, tmp_path):
    store = labelled_store(spark, tmp_path)
    log = tmp_path / "asked"
    log.mkdir()

    def ask(prompt, folder=str(log), broken=True):
        ids = [int(line.split("id=")[1].split("]")[0]) for line in prompt.splitlines() if "[id=" in line]
        with open(f"{folder}/{ids[0]}", "a") as out:
            out.write("x")
        if broken and ids[0] == 16:
            raise RuntimeError("busy")
        return json.dumps([{"sag_id": i, "kategorier": ["Energi", "unknown"]} for i in ids])

    job = LabelJob(store, ask, tasks=2, batches_per_commit=2)
    job.prompts()
    job.ask_all()  # and then a stop, before any label is stored
    assert store.read("bill_topic").count() == 1
    mended = LabelJob(store, lambda prompt: ask(prompt, broken=False), tasks=2)
    counts = {r["batch"]: r["labels"] for r in mended.run().collect()}
    assert counts == {0: 15, 1: 15, 2: 9}
    assert {f.name: f.read_text() for f in log.iterdir()} == {"1": "x", "16": "xx", "31": "x"}
    assert sorted(rows(store.read("bill_topic"))) == [*((n, 1) for n in range(1, 40)), (40, 2)]
    assert store.progress("labelling") == "done"
    assert mended.run().count() == 0  # nothing is open any more


def test_repairs_change_the_stored_tables(spark, landed, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    loading.Load(store, landed).run()
    land(tmp_path / "again" / "bill", [{"id": 50, "nummer": "L 2"}, {"id": 50, "nummer": "L 1 B"}])
    job = RepairJob(store, {"actor": landed["actor"], "bill": str(tmp_path / "again" / "bill")})
    job.parties()
    parties = {r["abbreviation"]: r["id"] for r in store.read("party").collect() if r["name"] in ("New", "Alpha")}
    assert parties["N"] == 13
    assert {r["id"]: r["party_id"] for r in store.read("member").collect()} == {1: 10, 2: 13, 3: 13, 4: None}
    assert rows(job.numbers()) == [(1, 1)]
    assert rows(store.read("bill"), "id", "number") == [(50, "L 1 B")]


def test_a_stream_log_enters_the_store_by_the_rules_of_the_load(spark, landed, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, landed)
    for step in (load.lookups, load.actors, load.ballots):
        step()
    stream = stream_pages(spark, landed["vote"], RECORDS["vote"])
    log = str(tmp_path / "log")
    stream_votes(build.build_votes(stream), log, str(tmp_path / "checkpoint")).awaitTermination()
    for _ in range(2):
        store_log(store, log)
        assert sorted(rows(store.read("vote"), "id")) == [(1,), (2,), (3,)]
        assert sorted(rows(store.read("rejected_vote"), "id", "reason")) == [(4, "member"), (6, "vote_type")]


def test_one_member_skips_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "ROW_GROUP_BYTES", 16 * 1024)
    store = Store.create(spark, str(tmp_path))
    votes = spark.range(200_000).selectExpr(
        "id", "id div 50 AS ballot_id", "IF(id = 77777, 5, 10 + id % 50000 * 2) AS member_id", "1L AS vote_type_id"
    )
    store.write("vote", votes)

    def read(member):
        one = store.read("vote").where(F.col("member_id") == member)
        found = one.collect()
        scans = one._jdf.queryExecution().executedPlan().collectLeaves()
        return len(found), scans.apply(0).metrics().apply("numOutputRows").value()

    found, scanned = read(5)
    assert found == 1 and scanned < 100_000
    assert read(11)[0] == 0


def test_a_settled_table_leaves_no_others(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))

    def make():
        inner = session.settled(lambda: cut(spark.range(5)).where("id > 1"))
        return cut(inner).where("id > 2")

    out = session.settled(make)
    assert sorted(r["id"] for r in out.collect()) == [3, 4]
    assert len(set(os.listdir(folder)) - before) == 1
    with pytest.raises(ZeroDivisionError):
        session.settled(lambda: 1 / 0)
    assert session._MADE == []
