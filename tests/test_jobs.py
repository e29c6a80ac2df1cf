"""Load, repair, label and streaming jobs on small landed feeds."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from frames import frames, rows
from tellers.plans import build, labelling, loading, quality, repair
from tellers.plans.tables import Tables
from tellers.schema import CONSTRAINTS, RECORDS, TABLES, TOPIC_NAMES
from tellers.session import local_rows
from tellers.sources.landed import stream_pages
from tellers.sources.store import Store, current_state
from tellers.streaming.votes import read_log, stream_votes

FEED = {
    "ballot_type": [{"id": 1, "type": "Final"}, {"id": 2, "type": "Motion"}],
    "vote_type": [{"id": 1, "type": "For"}, {"id": 2, "type": "Against"}],
    "actor": [
        {"id": 1, "typeid": 5, "fornavn": "Bo", "efternavn": "Dahl", "gruppenavnkort": "A",
         "biografi": "<m><partyShortname>A</partyShortname><party>Alpha</party></m>"},
        {"id": 2, "typeid": 5, "fornavn": None, "gruppenavnkort": "",
         "biografi": "<m><partyShortname>N</partyShortname><party>New</party></m>"},
        {"id": 3, "typeid": 5, "fornavn": "Eva", "efternavn": "Friis", "gruppenavnkort": "X",
         "biografi": "<m><partyShortname>N</partyShortname><party>Other</party></m>"},
        {"id": 4, "typeid": 5, "efternavn": "Broken", "biografi": "<m><party>"},
        {"id": 10, "typeid": 9, "navn": " Alpha ", "gruppenavnkort": "A"},
        {"id": 11, "typeid": 9, "navn": "Alpha too", "gruppenavnkort": "A"},
        {"id": 12, "typeid": 9, "navn": None, "fornavn": "No", "gruppenavnkort": ""},
        {"id": 13, "typeid": 7, "navn": "committee"},
    ],
    "ballot": [
        {"id": 100, "nummer": 1, "vedtaget": True, "typeid": 1, "sagstrinid": 1},
        {"id": 101, "nummer": 2, "vedtaget": None, "typeid": 1, "sagstrinid": 2},
        {"id": 102, "nummer": 3, "vedtaget": False, "typeid": 2, "sagstrinid": 3},
        {"id": 103, "nummer": 4, "sagstrinid": 0, "opdateringsdato": "2023-01-01T00:00:00"},
        {"id": 104, "nummer": 5, "sagstrinid": None},
        {"id": 105, "nummer": 6, "sagstrinid": 4},
        {"id": 106, "nummer": 7, "sagstrinid": 77},
    ],
    "step": [
        {"id": 1, "dato": "2022-11-01T00:00:00", "sagid": 50},
        {"id": 2, "dato": "2022-10-31T23:59:59", "sagid": 51},
        {"id": 3, "dato": "2023-02-03T13:45:10.25", "sagid": None},
        {"id": 4, "dato": None, "sagid": 50},
    ],
    "bill": [
        {"id": 50, "titel": "T", "titelkort": "t", "nummer": "L 1", "typeid": 3, "periodeid": 9},
        {"id": 51, "titel": "U"},
    ],
    "vote": [
        {"id": 1, "afstemningid": 100, "aktørid": 1, "typeid": 1},
        {"id": 2, "afstemningid": 100, "aktørid": 2, "typeid": 2},
        {"id": 3, "afstemningid": 102, "aktørid": 3, "typeid": 1},
        {"id": 4, "afstemningid": 102, "aktørid": 99, "typeid": 1},
        {"id": 5, "afstemningid": 101, "aktørid": 1, "typeid": 1},
    ],
}


def land(folder, records, page=3, name="p0.json"):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", encoding="utf-8") as out:
        for i in range(0, len(records), page):
            value = {"odata.count": str(len(records)), "value": records[i:i + page]}
            out.write(json.dumps(value, ensure_ascii=False) + "\n")


@pytest.fixture
def landed(tmp_path):
    for kind, records in FEED.items():
        land(tmp_path / "feed" / kind, records)
    return {kind: str(tmp_path / "feed" / kind) for kind in FEED}


def test_load_from_pages_and_again(spark, landed, tmp_path):
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, landed)
    counts = {r["table"]: r["rows"] for r in load.run_if_empty().collect()}
    assert counts == {
        "ballot_type": 2, "vote_type": 2, "party": 3, "member": 4, "bill": 1, "topic": 19,
        "ballot": 2, "vote": 3,
    }
    assert load.run_if_empty() is None
    assert store.progress(loading.LAST_STEP) == "5"
    before = sorted(rows(store.read("vote")))
    assert before == [(1, 100, 1, 1), (2, 100, 2, 2), (3, 102, 3, 1)]
    assert rows(store.read("rejected_vote"), "member_id") == [(99,)]
    ballots = {r["id"]: r for r in store.read("ballot").collect()}
    assert set(ballots) == {100, 102}
    assert ballots[100]["passed"] and not ballots[102]["passed"]
    assert str(ballots[102]["held_at"]) == "2023-02-03 13:45:10.250000"
    assert sorted(rows(store.read("member"))) == [
        (1, "Bo", "Dahl", "A", 11), (2, "", "", "", None), (3, "Eva", "Friis", "X", None),
        (4, "", "Broken", None, None),
    ]
    assert sorted(rows(store.read("party"))) == [
        (10, "A", "Alpha"), (11, "A", "Alpha too"), (12, "12", "No"),
    ]
    load.votes()  # a second time adds nothing
    load.topics()
    assert sorted(rows(store.read("vote"))) == before
    assert store.read("topic").count() == 19
    assert store.read("rejected_vote").count() == 1
    report = quality.constraint_report(Tables.of_store(store, TABLES), CONSTRAINTS).collect()
    assert {r["rule"] for r in report if r["violations"]} == set()


def test_load_goes_on_after_a_stop(spark, landed, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "store"))
    load = loading.Load(store, landed)
    ran = []

    def broken():
        raise RuntimeError("stopped")

    steps = [lambda: ran.append(1), lambda: ran.append(2), broken]
    with pytest.raises(RuntimeError):
        loading.run_steps(store, steps)
    assert store.progress(loading.LAST_STEP) == "2"
    assert loading.run_steps(store, [*steps[:2], lambda: ran.append(3)]) == 1
    assert ran == [1, 2, 3]
    assert load.store.read("vote").isEmpty()


def test_store_replaces_and_appends(spark, tmp_path):
    store = Store.create(spark, str(tmp_path))
    assert store.read("topic").count() == 0
    first = store.write("topic", local_rows(spark, [(1, "a")], TABLES["topic"]))
    store.write("topic", first.unionByName(local_rows(spark, [(2, "b")], TABLES["topic"])))
    assert sorted(rows(store.read("topic"))) == [(1, "a"), (2, "b")]
    store.append(topic=local_rows(spark, [(3, "c")], TABLES["topic"]))
    assert sorted(rows(store.read("topic"))) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(rows(store.write("topic", store.read("topic").where("id > 1")))) == [(2, "b"), (3, "c")]


def test_ledger_keeps_the_last_value(spark):
    log = spark.createDataFrame([("a", "1", 1), ("b", "9", 2), ("a", "2", 3)], "key STRING, value STRING, seq BIGINT")
    assert sorted(rows(current_state(log))) == [("a", "2"), ("b", "9")]


def test_topic_seed(spark):
    old = local_rows(spark, [(4, "Energi"), (9, "Own")], TABLES["topic"])
    seeded = {r["name"]: r["id"] for r in loading.seed_topics(old).collect()}
    assert len(seeded) == 20 and seeded["Energi"] == 4 and seeded["Own"] == 9
    assert [seeded[n] for n in TOPIC_NAMES[:3]] == [10, 11, 12] and seeded["Bolig"] == 27
    empty = local_rows(spark, [], TABLES["topic"])
    assert sorted(rows(loading.seed_topics(empty)))[0] == (1, TOPIC_NAMES[0])


def test_a_ballot_with_any_vote_is_done(spark):
    kind = TABLES["vote"]
    stored = local_rows(spark, [(1, 100, 1, 1)], kind)
    landed = local_rows(spark, [(1, 100, 1, 1), (2, 100, 2, 1), (3, 101, 1, 1), (3, 101, 1, 2)], kind)
    once = loading.incremental_votes(stored, landed)
    assert sorted(rows(once)) == [(1, 100, 1, 1), (3, 101, 1, 2)]
    assert sorted(rows(loading.incremental_votes(once, landed))) == sorted(rows(once))


def test_parties_and_members_from_biographies(spark):
    actors = local_rows(
        spark, [tuple(a.get(f.name) for f in RECORDS["actor"]) for a in FEED["actor"]], RECORDS["actor"]
    )
    parsed = repair.member_parties(actors)
    assert rows(repair.party_codes(parsed)) == [("A",), ("N",)]
    parties = repair.add_parties(build.build_parties(actors), parsed)
    assert sorted(rows(parties)) == [
        (10, "A", "Alpha"), (11, "A", "Alpha too"), (12, "12", "No"), (13, "N", "New"),
    ]
    fixed = sorted(rows(repair.repair_members(build.build_members(actors), parsed, parties)))
    assert fixed == [
        (1, "Bo", "Dahl", "A", 10), (2, "", "", "N", 13),
        (3, "Eva", "Friis", "N", 13),  # its own name for N is not the first: matched on N alone
        (4, "", "Broken", None, None),
    ]


def test_bill_numbers(spark):
    t = frames(spark)
    records = spark.createDataFrame([(10, "B 7"), (11, None)], "id BIGINT, nummer STRING")
    assert sorted(rows(repair.repair_numbers(t["bill"], records), "id", "number")) == [
        (10, "B 7"), (11, None), (12, "L 3"),
    ]
    assert tuple(repair.numbered_bills(t["bill"], records).first()) == (1, 3)
    assert repair.sample_bills(t["bill"], 2).count() == 2
    assert repair.sample_members(t, 3).count() == 3


def test_null_keys_do_not_hide_unlabelled_bills(spark):
    t = frames(spark)
    assert rows(labelling.unlabelled_bills(t["bill"], t["bill_topic"]), "id") == [(12,)]


def test_prompts(spark):
    wide = "ø" * 299 + "😀"
    bills = local_rows(spark, [
        (1, "T", "t", wide, None, 1, 1), (2, "", "short", wide + "x", None, 1, 1),
        (3, None, None, "", None, 1, 1), (4, None, "s", None, None, 1, 1),
    ], TABLES["bill"])
    prompts = labelling.prompt_batches(bills, head="H\n", batch_size=3).orderBy("batch").collect()
    assert [(p["batch"], p["bills"]) for p in prompts] == [(0, 3), (1, 1)]
    assert prompts[0]["prompt"] == (
        f"H\n1. [id=1] T\n   Resume: {wide}\n\n2. [id=2] short\n   Resume: {wide}...\n\n"
        "3. [id=3] Uden titel\n   Resume: \n\n"
    )
    assert prompts[1]["prompt"] == "H\n1. [id=4] s\n   Resume: s\n\n"
    assert all(f"- {name}\n" in labelling.instructions() for name in TOPIC_NAMES)


def test_label_calls_go_on_after_a_failure(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "batch BIGINT, prompt STRING")

    def ask(prompt):
        if prompt == "p3":
            raise ValueError("no")
        return prompt.upper()

    answers = {r["batch"]: (r["response"], r["error"]) for r in labelling.label_batches(prompts, ask).collect()}
    assert answers[3] == (None, "no") and answers[4] == ("P4", None) and len(answers) == 5


def test_labels_are_ingested(spark):
    t = frames(spark)
    answer = [
        {"sag_id": 12, "kategorier": ["Energi", "Energi", "Ukendt"]},
        {"sag_id": 10, "kategorier": ["Energi"]},   # stored already
        {"sag_id": 777, "kategorier": ["Bolig"]},   # no such bill
        {"kategorier": ["Bolig"]},                  # no bill at all
    ]
    responses = spark.createDataFrame(
        [(0, json.dumps(answer)), (1, "[{"), (2, None), (3, '[{"sag_id": 11, "kategorier": ["Energi"]}]')],
        "batch BIGINT, response STRING",
    )
    parsed = labelling.parse_responses(responses)
    new = labelling.new_labels(parsed, t["topic"], t["bill"], t["bill_topic"])
    assert sorted(rows(new)) == [(11, 1), (12, 1)]
    stored = labelling.ingest_labels(parsed, t["topic"], t["bill"], t["bill_topic"])
    assert stored.count() == 7
    assert labelling.new_labels(parsed, t["topic"], t["bill"], stored).isEmpty()
    assert sorted(rows(labelling.label_counts(parsed, t["topic"]))) == [(0, 5), (3, 1)]
    orphans = labelling.orphan_labels(parsed, t["topic"], t["bill"])
    assert sorted(rows(orphans, "bill_id"), key=str) == [(777,), (None,)]
    assert sorted(rows(labelling.rejected_responses(responses), "batch")) == [(1,), (2,)]


def test_constraints(spark):
    t = frames(spark)
    found = {
        (r["table"], r["rule"]): r["violations"]
        for r in quality.constraint_report(t, [n for n in CONSTRAINTS if n != "load_progress"]).collect()
    }
    assert {k: v for k, v in found.items() if v} == {
        ("ballot", "reference type_id to ballot_type"): 1,
        ("ballot", "reference bill_id to bill"): 1,
        ("vote", "reference ballot_id to ballot"): 1,
        ("vote", "reference member_id to member"): 1,
        ("vote", "reference vote_type_id to vote_type"): 1,
    }
    broken = frames(
        spark, topic=[(1, "x"), (1, "y"), (2, None), (3, "y")], vote=[(1, 100, None, 1), (1, 100, 1, 1)]
    )
    found = {r["rule"]: r["violations"] for r in quality.constraint_report(broken, ["topic", "vote"]).collect()}
    assert found["unique name"] == 1 and found["required name"] == 1
    assert found["required member_id"] == 1 and found["required ballot_id"] == 0


def test_counts(spark):
    counts = {r["table"]: r["rows"] for r in quality.table_counts(frames(spark)).collect()}
    assert counts["vote"] == 10 and counts["member"] == 5 and len(counts) == 8


def test_vote_stream_restarts(spark, tmp_path):
    feed, log, state = tmp_path / "votes", str(tmp_path / "log"), str(tmp_path / "state")

    def run():
        votes = build.build_votes(stream_pages(spark, str(feed), RECORDS["vote"], 1))
        stream_votes(votes, log, state).awaitTermination()
        return sorted(rows(read_log(spark, log, TABLES["vote"])))

    land(feed, FEED["vote"][:3])
    first = run()
    assert first == [(1, 100, 1, 1), (2, 100, 2, 2), (3, 102, 3, 1)]
    assert run() == first  # nothing new
    land(feed, FEED["vote"], name="again.json")  # the same votes and two more
    changed = [dict(FEED["vote"][0], typeid=2)]
    land(feed, changed, name="later.json")
    assert sorted(r[0] for r in run()) == [1, 2, 3, 4, 5]


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path):
    log = str(tmp_path / "log")
    votes = local_rows(spark, [(1, 100, 1, 1), (1, 100, 1, 2), (2, 100, 2, 1)], TABLES["vote"])
    from tellers.operators.keyed import latest

    for _ in range(2):  # what the stream does for one batch
        latest(votes, ["id"], ["vote_type_id"]).write.mode("overwrite").parquet(f"{log}/batch=0")
    votes.where("id = 2").withColumn("vote_type_id", F.lit(3).cast("long")).write.parquet(f"{log}/batch=1")
    assert sorted(rows(read_log(spark, log, TABLES["vote"]))) == [(1, 100, 1, 2), (2, 100, 2, 3)]
