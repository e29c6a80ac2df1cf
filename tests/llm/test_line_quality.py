"""The line model against all labellings of short texts, its gradient, and held-out labels."""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_frames import ODD, by_id, frame
from llm_folder import FOLDER
from tellers.llm import registry
from tellers.llm.line_quality import (
    LineModel, OWN, fit, gradient, line_features, marginals, rate, score, train,
)
from tellers.session import local_rows


def likelihoods(emission, good, bad):
    """exp(score) of every labelling of one text."""
    out = {}
    for labels in product((0, 1), repeat=len(emission)):
        total = sum(e for e, y in zip(emission, labels) if y)
        total += sum(good if y and z else bad if not y and not z else 0 for y, z in zip(labels, labels[1:]))
        out[labels] = np.exp(total)
    return out


TEXTS = st.lists(st.lists(st.floats(-4, 4), min_size=1, max_size=6), min_size=1, max_size=5)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.floats(-2, 3), st.floats(-2, 3))
def test_marginals_are_sums_over_labellings(texts, good, bad):
    counts = np.array([len(t) for t in texts])
    got = marginals(np.concatenate([np.array(t) for t in texts]), counts, good, bad)
    want = []
    for t in texts:
        of = likelihoods(t, good, bad)
        want += [sum(p for y, p in of.items() if y[at]) / sum(of.values()) for at in range(len(t))]
    assert np.allclose(got, want)


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(5)
    counts, labels, weights = np.array([3, 1, 4]), np.array([1.0, 0.0, 0.0]), np.array([1.0, 2.0, 0.5])
    x, theta = draw.normal(size=(8, 3)), draw.normal(size=5)

    def value(theta):
        total, at = 0.0, 0
        for n, y, w in zip(counts, labels, weights):
            of = likelihoods(x[at:at + n] @ theta[:-2], *theta[-2:])
            total += w * np.log(of[(int(y),) * n] / sum(of.values()))
            at += n
        return total

    step = 1e-6
    want = [(value(theta + step * e) - value(theta - step * e)) / (2 * step) for e in np.eye(5)]
    assert np.allclose(gradient(x, counts, labels, weights, theta), want, atol=1e-6)


def test_features_of_neighbours_stay_inside_a_text():
    x, lengths, counts = line_features(["a b\nAA!! AA!!\n", "", "z"])
    assert counts.tolist() == [3, 1, 1] and lengths.tolist() == [4, 10, 1, 1, 2]
    own, before, after = x[:, :OWN], x[:, OWN:2 * OWN], x[:, 2 * OWN:]
    assert (before[[0, 3, 4]] == 0).all() and (after[[2, 3, 4]] == 0).all()
    assert (before[1:3] == own[:2]).all() and (after[:2] == own[1:3]).all()


def test_neighbours_decide_a_line_that_says_nothing():
    x, _, counts = line_features(["fine\nfine\nfine", "BAD\nBAD\nBAD"])
    model = fit(x, counts, np.array([1.0, 0.0]), np.ones(2))
    assert model.good > 0 and model.bad > 0
    unsure = marginals(np.array([3.0, 0.0, 3.0, -3.0, 0.0, -3.0]), np.array([3, 3]), model.good, model.bad)
    assert unsure[1] > 0.6 and unsure[4] < 0.4


def test_quality_is_the_mean_by_length():
    weights = np.zeros(3 * OWN)
    weights[1] = -50.0  # capitals
    model = LineModel(np.zeros(3 * OWN), np.ones(3 * OWN), weights, 0.0, 0.0)
    assert score(model, ["ab\n" + "X" * 8])[0] == pytest.approx((3 * 0.5 + 9 * 0.0) / 12, abs=1e-6)


def test_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = registry.op13_score_quality(spark, folder).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 30 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_odd_rows_and_what_is_not_learned_from(spark, odd, none):
    texts = [(i, "a fine line of words\nand more of them") for i in range(20)] + [(i, "BAD!! BAD!! BAD!!") for i in range(20, 40)]
    texts += [(50, "BAD!!"), (50, "BAD!! BAD!!"), (51, "BAD!!\n" * 300)]
    given_ = [(i, int(i < 20)) for i in range(40)] + [(50, 1), (51, 1), (None, 1), (5, None), (5, 0), (99, 0)]
    docs = frame(spark, texts, id="x", good="x", body="x", score="x")
    model = train(docs, _labels(spark, given_))
    found = by_id(rate(docs, model))
    assert all(r["score"] > 0.9 for i in range(20) for r in found[i]) and all(r["score"] < 0.1 for i in range(20, 40) for r in found[i])
    assert found[50][0]["score"] < 0.5 and set(found[1][0]) == set(docs.columns)
    every = rate(odd, model).collect()
    assert len(every) == len(ODD) + 6 and all(0 <= r["score"] <= 1 for r in every)
    empty = {r["score"] for r in every if not r["text"]}
    assert len(empty) == 1
    assert rate(none, model).count() == 0


def test_without_labels_every_text_is_even(spark):
    docs = frame(spark, [(1, "some words"), (2, None)])
    model = train(docs, _labels(spark, []))
    assert [r["score"] for r in rate(docs, model).collect()] == [0.5, 0.5]


def test_one_quality_alone(spark):
    docs = frame(spark, [(i, f"line {i}") for i in range(30)])
    model = train(docs, _labels(spark, [(i, 0) for i in range(30)]))
    assert rate(docs, model).agg(F.max("score")).first()[0] < 0.5


def test_very_long_text():
    model = fit(*line_features(["good words\n" * 3, "BAD\n" * 3])[::2], np.array([1.0, 0.0]), np.ones(2))
    long = score(model, ["good words\n" * 100_000, "x" * 3_000_000])
    assert 0 <= long[1] <= 1 and long[0] > 0.5
