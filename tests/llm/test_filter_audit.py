"""The filter interaction audit against a document at a time."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from brute import words
from compare import differences
from corpus_frames import frame
from llm_folder import FOLDER
from tellers.llm import filter_audit
from tellers.llm.filter_audit import among, audit, flag_failures, gallop, interactions, merged
from tellers.session import local_rows

LABEL = T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer")
NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, _, source in rows:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
        }
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in of)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                lines.append((
                    f, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in of),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ))
        out += [(part, *line[1:], shapley[line[0]]) for line in lines]
    return sorted(out)


def audited(spark, rows, labels, **extra):
    found = audit(flag_failures(frame(spark, rows, **extra), local_rows(spark, labels, LABEL)))
    return sorted(tuple(r[n] for n in NAMES) for r in found.collect())


LONG = " ".join(f"w{n}" for n in range(250))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG + " #", "en", "b"), (4, "word " * 300, "en", "a"), (5, "THE END", "en", None),
    (6, None, "en", "b"), (7, "", "en", ""), (8, "é" * 60 + "A", "en", "c"), (None, LONG, "en", "a"), (None, None, "en", None),
    (2, LONG, "en", "a"), (2, "other | words", "en", "b"), (9, "THE END", "en", "a"), (10, "x y " * 250, "en", "c"), (-4, LONG + " 1", "en", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (4, 0, 1)]


def test_query_matches_its_sql(spark):
    assert differences(spark, FOLDER, "op12_audit_filters") == []


def test_odd_documents(spark):
    assert audited(spark, ROWS, LABELS) == plain(ROWS, LABELS)


def test_clashing_columns_and_empty_tables(spark):
    clash = {n: "x" for n in ("id", "row", "part", "hash", "body", "A", "E", "good", "toxic", "n", "first")}
    assert audited(spark, ROWS, [], **clash) == plain(ROWS, [])
    assert audited(spark, [], LABELS) == []


def test_a_part_in_many_ranges_adds_up(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i, f"t{i % 40} {'#' if i % 3 else ''}", "en", "hot" if i % 5 else "other") for i in range(300)]
        labels = [(i, i % 2, int(i % 7 == 0)) for i in range(300)]
        assert audited(spark, rows, labels) == plain(rows, labels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_text(spark):
    rows = [(1, "la " * 200_000, "en", "s"), (2, "la " * 200_000, "en", "s"), (3, "Ab" * 200_000, "en", "s")]
    assert audited(spark, rows, []) == plain(rows, [])


IDS = st.lists(st.integers(0, 900), unique=True).map(sorted).map(lambda ids: np.array(ids, np.int64))


@settings(max_examples=200, deadline=None)
@given(IDS, IDS)
def test_lists(a, b):
    assert gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    assert among(a, b).tolist() == [x in set(b.tolist()) for x in a.tolist()]
    new = a[~among(a, b)]
    assert merged(b, new).tolist() == sorted({*a.tolist(), *b.tolist()})


def test_long_runs_gallop_over_what_lies_between():
    long = np.arange(0, 1_000_000, 3)
    short = np.sort(np.random.default_rng(1).choice(1_000_000, 3000, replace=False))
    assert gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


@settings(max_examples=50, deadline=None)
@given(st.fixed_dictionaries({f: IDS for f in "ABC"}), IDS, IDS)
def test_every_union_and_difference(lists, good, toxic):
    sets = {f: set(ids.tolist()) for f, ids in lists.items()}
    found = interactions(lists, good, toxic)
    assert len(found) == 3 * 4
    for (before, f), sizes in found.items():
        gone = sets[f].difference(*(sets[b] for b in before))
        assert sizes == [len(gone), len(sets[f] - gone), len(gone & set(good.tolist())), len(gone & set(toxic.tolist()))]


def test_no_text_is_shuffled(spark):
    docs = frame(spark, ROWS)
    assert "body" not in flag_failures(docs, local_rows(spark, LABELS, LABEL)).columns
    assert filter_audit.REPEATED == "E"
