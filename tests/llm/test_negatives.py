"""Hard-negative mining against all scores, one anchor at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compare import differences
from llm_folder import FOLDER
from tellers.llm import hard_negatives
from tellers.llm.hard_negatives import Bucket, mine, search_bucket
from tellers.session import local_rows

VECTOR = T.StructType().add("vec_id", "long").add("label", "integer").add("embedding", T.ArrayType(T.DoubleType()))


def plain(rows, positives=5, negatives=10):
    """All of it by sorting all rows of each anchor."""
    usable = [
        (i, str(l), [math.floor(256 * x) for x in v]) for i, l, v in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in sorted({(i, l, tuple(v)) for i, l, v in usable if i % 100 == 0}):
        scored = sorted((-dot(v, w), j, l) for j, l, w in usable)
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, n, s[1], -p, -s[0]) for n, s in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    found = mine(local_rows(spark, rows, VECTOR), F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def cloud(seed, n, width=6, labels=3):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.gauss(0, 1) * (1 + i % 4) for _ in range(width)]) for i in range(n)]


def test_query_matches_its_sql(spark):
    assert differences(spark, FOLDER, "op11_mine_negatives") == []


def test_all_scores_agree_whatever_the_buckets_and_blocks(spark):
    rows = cloud(1, 700)
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, numbers_per_bucket=60, anchors_per_block=2) == want


def test_ties_repeats_and_rows_that_take_no_part(spark):
    one = [1.0, 0.5]
    rows = [(0, 1, one), (0, 1, one), (100, 2, one), (5, 1, one), (5, 1, one), (6, 1, one), (7, 2, [0.7, 0.3]), (8, 2, [0.7, 0.3])]
    rows += [(9, 3, [0.6, 0.4]), (9, 3, [0.6, 0.4]), (10, 3, [-1.0, -1.0]), (200, 1, [0.0, 0.0]), (300, 9, [-1.0, 0.0])]
    rows += [(11, None, one), (None, 1, one), (12, 2, None), (13, 2, [1.0, None]), (14, 2, [float("nan"), 1.0]), (15, 2, [float("-inf"), 1.0])]
    rows += [(16, 2, [1e307, 0.0]), (17, 4, []), (18, 4, [0.8]), (400, 4, [])]
    assert mined(spark, rows) == plain([r for r in rows if r[0] != 16])
    assert mined(spark, []) == [] and mined(spark, rows[3:6]) == []


def test_scores_beyond_53_bits_are_exact_and_beyond_64_bits_end_there(spark):
    rows = [(0, 1, [1e5, 3.0]), (1, 1, [123456.7, 1.0]), (2, 2, [61234.56, 2.0]), (3, 2, [61234.57, 5e6])]
    rows += [(100, 3, [4e6, 7.0]), (101, 3, [4e6, 5.0]), (102, 4, [2e6, 3.0])]
    assert mined(spark, rows) == plain(rows)
    vast = [(0, 1, [1e20]), (1, 1, [1e20]), (2, 2, [1e2])]
    assert mined(spark, vast) == [] and hard_negatives._MOST == Bucket(
        np.array([1]), np.array(["1"], object), np.array([[1e20]])
    ).scores(np.array([1e20]), np.array([0]))[0]


def test_other_columns_do_not_clash(spark):
    names = ("id", "label_", "bucket", "block", "anchor", "band", "score", "rank", "length")
    df = local_rows(spark, cloud(2, 300), VECTOR).select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(map(tuple, mine(df, F.col("vec_id") % 100 == 0).collect())) == plain(cloud(2, 300))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.3, 0.99), st.integers(2, 40))
def test_the_ranges_lose_no_row(seed, cosine, width):
    draw = np.random.default_rng(seed)
    vectors = np.floor(256 * draw.normal(size=(400, width)))
    vectors[:200] += vectors[0] * draw.uniform(0, 4, size=(200, 1))
    bucket = Bucket(np.arange(400), np.array(["a"] * 400, object), vectors)
    for at in range(0, 400, 50):
        q = vectors[at] / np.linalg.norm(vectors[at])
        found = bucket.candidates(q, cosine)
        near = np.flatnonzero(bucket.vectors @ q >= cosine * bucket.longest)
        assert found is None or set(near) <= set(found)


def test_lists_rule_most_rows_out():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16)) * 100
    vectors = np.floor(np.repeat(centres, 100, axis=0) + draw.normal(size=(4000, 16)))
    bucket = Bucket(np.arange(4000), np.array(["a"] * 4000, object), vectors / np.linalg.norm(vectors, axis=1)[:, None] * 1000 // 1)
    q = bucket.vectors[7] / np.linalg.norm(bucket.vectors[7])
    found = bucket.candidates(q, 0.98)
    assert found is not None and 100 <= len(found) < 400


@pytest.mark.parametrize("same", [True, False])
def test_a_bucket_out_of_reach_is_left_out(same):
    bucket = Bucket(np.arange(3), np.array(["a", "a", "b"], object), np.ones((3, 2)))
    args = np.array([9]), np.array(["a"], object), np.array([[3.0, 3.0]])
    assert list(search_bucket(bucket, *args, [[(0, 7, 99)]], 5, same)) == []
    assert len(list(search_bucket(bucket, *args, [[(0, 6, 99)]], 5, same))) == 1
