"""The stages of the pipeline and all of it, against plain versions."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import components, ngrams, string_tiles, words
from corpus_frames import FOLDER, frame
from tellers.llm import sharding
from tellers.session import cut

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage gave, by name, from the documents on."""
    docs, out = documents, {"documents": documents.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
        out[name] = docs.collect()
        if name != "shards":
            assert docs.columns == documents.columns and docs.schema.simpleString() == documents.schema.simpleString()
    return out


def test_language_stage_keeps_documents_of_a_language(stages):
    assert {r["doc_id"] for r in stages["language"]} == {r["doc_id"] for r in stages["documents"]}


def test_similar_stage_keeps_the_first_of_each_component(stages):
    want = components({r["doc_id"]: ngrams(r["text"], 5) for r in stages["language"]}, 80)
    assert sorted(r["doc_id"] for r in stages["similar"]) == sorted(set(want.values()))


def test_leak_stage_drops_what_tiles_cover(spark, stages):
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages["leaks"]}
    for r in stages["similar"]:
        doc = plain(r["text"])
        grams = {tuple(doc[a:a + 5]) for a in range(len(doc) - 4)}
        likely = [i for i in items if any(tuple(i[a:a + 5]) in grams for a in range(len(i) - 4))]
        assert (r["doc_id"] not in kept) == any(
            2 * sum(n for _, _, n in string_tiles(i, doc, 5)) >= len(i) for i in likely
        )


def test_mix_stage_repeats_documents_to_meet_the_targets(stages):
    before = {r["doc_id"]: r for r in stages["leaks"]}
    totals = {}
    for r in stages["mix"]:
        whole = before[r["doc_id"]]
        assert r["lang"] == whole["lang"] and r["source"] == whole["source"]
        if r["text"] != whole["text"]:
            part = words(r["text"])
            assert part == words(whole["text"])[:len(part)] and r["n_chars"] == len(r["text"])
        totals[r["source"]] = totals.get(r["source"], 0) + len(words(r["text"]))
    assert abs(sum(totals.values()) - sum(len(words(r["text"])) for r in before.values())) <= len(totals)


def test_shard_stage_places_each_row(stages):
    owner = sharding.lookup_table()
    assert len(stages["shards"]) == len(stages["mix"])
    for r in stages["shards"]:
        assert r["shard"] == owner[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS]


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["shards"]))


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
        found = stage(spark, odd, FOLDER)
        found.collect()
        assert set(found.columns) >= set(odd.columns), name
    kept = STAGES["language"](spark, odd, FOLDER)
    assert kept.where(~F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}"))).count() == 0
    similar = STAGES["similar"](spark, odd, FOLDER).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in similar if r["doc_id"] in (3, 7, 101)) == [
        (3, "other words"), (3, "word"), (7, "la " * 20_000)
    ]


def test_language_stage_rejects_texts_without_letters_only(spark):
    docs = frame(spark, [(1, "the house is there", "en"), (2, "das Haus ist da", "de"), (3, "12 34", "en"), (4, None, "de")])
    assert sorted(r["doc_id"] for r in STAGES["language"](spark, docs, FOLDER).collect()) == [1, 2]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in STAGES["language"](spark, unlabelled, FOLDER).collect()) == [1, 2]


def test_similar_stage_judges_each_text_of_a_repeated_doc_id(spark):
    a, b, alone = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    near = a + " more"
    rows = [(1, a), (2, a), (2, alone), (2, alone), (3, near), (None, near), (None, b), (None, b + " x"), (4, None), (4, ""), (5, "")]
    docs = frame(spark, rows, _stage_tag="x", component="x", text_tag="x", _stage_gone="x", node="x")
    kept = STAGES["similar"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect()), key=str)
    assert found == sorted([(1, "a0"), (2, "c0"), (None, "b0"), (4, ""), (5, "")], key=str)


def test_leak_stage_keeps_documents_that_hold_a_short_item(spark, tmp_path):
    items = [(1, "Yes"), (2, "one two three four five six")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(1, "yes it is"), (2, "so one two three four five six go"), (3, None), (3, "")])
    assert sorted(r["doc_id"] for r in STAGES["leaks"](spark, docs, str(tmp_path)).collect()) == [1, 3, 3]


def test_stages_keep_columns_of_any_name(spark):
    names = ("_stage_lang", "_stage_score", "_stage_tag", "_stage_hits", "_leak_hits", "_leak_new", "_text_of_row", "size", "part", "identity")
    docs = frame(spark, [(1, "the house is there and so on", "en"), (2, "das Haus ist da und so weiter", "de")], **{n: n for n in names})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
