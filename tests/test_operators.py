"""Operators and column functions on literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tellers.functions.biography import party_of
from tellers.functions.responses import labelled_items, unfence
from tellers.functions.text import first_filled, parse_flag, strip
from tellers.operators import keyed
from tellers.operators.numbering import number_rows
from tellers.operators.sizing import splittable_join
from tellers.sources.landed import completeness, explode_pages, restrict_to_ids
from tellers.schema import RECORDS


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_and_ignore(spark):
    target = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k INT, v STRING, n INT")
    batch = spark.createDataFrame([(2, "a", 1), (2, "b", 2), (3, "c", 9), (3, "d", 3)], target.schema)
    up = keyed.upsert(target, batch, ["k"], ["n"])
    assert got(up) == [(1, "old", 0), (2, "b", 2), (3, "c", 9)]
    assert got(keyed.upsert(up, batch, ["k"], ["n"])) == got(up)
    ignored = keyed.insert_ignore(target, batch, ["k"], ["n"])
    assert got(ignored) == [(1, "old", 0), (2, "old", 0), (3, "d", 3)]
    assert got(keyed.insert_ignore(ignored, batch, ["k"], ["n"])) == got(ignored)


@pytest.mark.parametrize("ids", [
    list(range(1000)),
    [7] + [10**15 + i for i in range(500)] + [-(10**17)],
    random.Random(3).sample(range(10**12), 1200),
])
def test_numbers_follow_the_key(spark, ids):
    shuffled = random.Random(1).sample(ids, len(ids))
    df = spark.createDataFrame([(i,) for i in shuffled], "id BIGINT")
    for rows_per_bucket in (10_000, 50):
        numbered = number_rows(df, "id", "n", rows_per_bucket)
        assert [r["id"] for r in numbered.orderBy("n").collect()] == sorted(ids)
        assert [r["n"] for r in numbered.orderBy("n").collect()] == list(range(1, len(ids) + 1))


def test_numbering_cuts_even_buckets(spark):
    ids = [10**15 + i for i in range(4000)] + [5]
    numbered = number_rows(spark.createDataFrame([(i,) for i in ids], "id BIGINT"), "id", "n", 500)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_bucket" in text
    assert numbered.count() == 4001


def test_rows_without_a_key_spread_and_stay(spark):
    left = spark.range(1000).selectExpr("IF(id < 900, NULL, id) AS k", "id AS v")
    right = spark.range(950, 2000).selectExpr("id AS k", "id * 2 AS w").groupBy("k").agg(F.max("w").alias("w"))
    joined = splittable_join(left, right, ["k"], "left")
    assert joined.count() == 1000 and joined.where("w IS NOT NULL").count() == 50
    assert splittable_join(left, right, ["k"], "left_anti").count() == 950
    assert splittable_join(left, right, ["k"], "left_semi").count() == 50
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sizes = splittable_join(left, right, ["k"], "left").where("k IS NULL").groupBy(F.spark_partition_id()).count()
        assert sizes.agg(F.max("count")).first()[0] < 450
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_hot_key_is_split_although_a_side_is_aggregated(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
        left = spark.range(0, 200_000, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
        right = spark.range(0, 5000, 1, 4).select((F.col("id") % 1000).alias("k")).groupBy("k").agg(
            F.count(F.lit(1)).alias("n")
        )
        joined = splittable_join(left, right, ["k"], "left")
        assert joined.count() == 200_000
        rows = joined.collect()
        assert len(rows) == 200_000 and {r["n"] for r in rows} == {5}
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        for how, count in (("left_anti", 0), ("left_semi", 200_000), ("inner", 200_000)):
            assert splittable_join(left, right, ["k"], how).count() == count
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_strip_and_fallbacks(spark):
    df = spark.createDataFrame([("\n\t a b  \r\n",), ("",), (None,)], "t STRING")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "", None]
    assert [r[0] for r in df.select(first_filled(F.col("t"), F.lit("x"))).collect()][1:] == ["x", "x"]


def test_flags():
    assert [parse_flag(t) for t in (None, "", "true", "TRUE", "false", "1")] == [
        None, None, True, True, False, False,
    ]


@pytest.mark.parametrize("xml, short, full", [
    ("<m><partyShortname>A</partyShortname><party>Alpha</party></m>", "A", "Alpha"),
    ("<m><partyShortname>A</partyShortname><partyShortname>B</partyShortname></m>", "A", None),
    ("<m><partyShortname> A </partyShortname><party> \n</party></m>", " A ", " \n"),
    ("<m><partyShortname>A</partyShortname><party>x</m>", None, None),
    ("<m><deep><party>no</party></deep><partyShortname>a &lt; b</partyShortname></m>", "a < b", None),
    ("", None, None), ("junk", None, None), (None, None, None), ("<m/>", None, None),
])
def test_biographies(spark, xml, short, full):
    df = spark.createDataFrame([(xml,)], "b STRING").select(party_of(F.col("b")).alias("p"))
    assert tuple(df.first()["p"]) == (short, full)


_OK = '[{"sag_id": 1, "kategorier": ["Energi", "Bolig"]}]'


@pytest.mark.parametrize("text, items", [
    (_OK, [("1", ["Energi", "Bolig"])]),
    (f" \n{_OK}\n ", [("1", ["Energi", "Bolig"])]),
    (f"```json\n{_OK}\n```", [("1", ["Energi", "Bolig"])]),
    (f"```\n{_OK}\nwhatever", [("1", ["Energi", "Bolig"])]),
    ('[{"sag_id": "7", "kategorier": ["x"]}]', [("7", ["x"])]),
    ('[{"kategorier": ["x"]}]', [(None, ["x"])]),
    ("[]", []),
    (_OK[:-1], None), (_OK + " trailing", None), (_OK + ", []", None), ("[1, 2]", None),
    ('{"sag_id": 1, "kategorier": ["x"]}', None), ("[null]", None), ("", None), (None, None),
    ("[{'sag_id': 1}]", None), (f"```json {_OK}```", None),
])
def test_responses(spark, text, items):
    df = spark.createDataFrame([(text,)], "r STRING").select(labelled_items(F.col("r")).alias("i"))
    row = df.first()["i"]
    assert (row if row is None else [(i["sag_id"], i["kategorier"]) for i in row]) == items


def test_unfence_keeps_inner_lines(spark):
    df = spark.createDataFrame([("```json\na\nb\n```",)], "r STRING")
    assert df.select(unfence(F.col("r"))).first()[0] == "a\nb"


def test_pages(spark):
    lines = [
        ('{"odata.count": "3", "value": [{"id": 1, "type": "x"}, {"id": 2, "type": "å"}]}',),
        ('{"odata.count": "3", "value": [{"id": 3}]}',), ('{"odata.count": "3", "value": []}',),
    ]
    pages = spark.createDataFrame(lines, "value STRING")
    assert [tuple(r) for r in explode_pages(pages, RECORDS["ballot_type"]).orderBy("id").collect()] == [
        (1, "x"), (2, "å"), (3, None),
    ]
    assert tuple(completeness(pages, RECORDS["ballot_type"]).first()) == (3, 0, 3, 3, True)
    first = completeness(pages.limit(1), RECORDS["ballot_type"]).first()
    assert (first["records"], first["complete"]) == (2, False)
    none = completeness(pages.limit(0), RECORDS["ballot_type"]).first()
    assert tuple(none) == (0, 0, 0, 0, True)


def test_restrict_to_ids(spark):
    records = spark.range(5)
    ids = spark.createDataFrame([(1,), (1,), (None,), (4,), (9,)], "x BIGINT")
    assert got(restrict_to_ids(records, ids)) == [(1,), (4,)]
