"""Operators that compare documents, against plain versions."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brute import components, kept_words, ngrams, string_tiles
from corpus_frames import FOLDER, ODD, by_id, frame
from tellers.llm import components as stars
from tellers.llm import decontamination, jaccard_join, packing, registry, rolling, substring_dedup
from tellers.session import local_rows


def copies(seed, many=60):
    """Texts with exact copies, near copies, shared passages and a common line."""
    draw = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = draw.choices(vocabulary, k=30)
    out = []
    for n in range(many):
        kind = draw.randrange(6)
        if kind < 3 or not out:
            text = draw.choices(vocabulary, k=draw.choice([0, 3, 5, 14, 60, 200]))
        elif kind == 3:
            text = list(draw.choice(out))
        else:
            text = list(draw.choice(out))
            for _ in range(draw.randrange(6)):
                if text:
                    text[draw.randrange(len(text))] = draw.choice(vocabulary)
        if draw.random() < 0.4:
            at = draw.randrange(len(text) + 1)
            text = text[:at] + passage + text[at:]
        out.append(text)
    return [(n, " ".join(t)) for n, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_a_plain_search(spark, seed):
    rows = copies(seed)
    got = by_id(substring_dedup.remove_repeats(frame(spark, rows)))
    for i, (words, gone) in kept_words(dict(rows), 13).items():
        [row] = got[i]
        assert row["n_words"] == len(words)
        assert row["kept"] == " ".join(w for w, g in zip(words, gone) if not g)
        flags = [False] * len(words)
        for span in row["removed"]:
            flags[span["start"]:span["end"]] = [True] * (span["end"] - span["start"])
        assert flags == gone
        assert all(a["end"] < b["start"] for a, b in zip(row["removed"], row["removed"][1:]))


def test_repeats_query_over_a_table(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = by_id(registry.op1_remove_repeats(spark, FOLDER))
    for i, (words, gone) in kept_words(texts, 13).items():
        [row] = got[i]
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (
            len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
        )


def test_repeats_of_odd_rows(spark, odd, none):
    assert substring_dedup.remove_repeats(none).count() == 0
    got = by_id(substring_dedup.remove_repeats(odd))
    assert [r["n_words"] for r in got[100]] == [0]
    assert sorted(r["kept"] for r in got[None]) == ["", "word"]
    assert sorted(r["kept"] for r in got[3]) == ["other words", "word", "word"]
    assert got[7][0]["removed"] == [] and got[101][0]["removed"] == [{"start": 0, "end": 20_000}]
    assert sum(map(len, got.values())) == odd.count()


def test_repeats_of_two_copies_in_one_partition(spark):
    text = " ".join(f"w{n}" for n in range(20))
    got = by_id(substring_dedup.remove_repeats(frame(spark, [(1, text), (2, text)]).coalesce(1)))
    assert [(r["kept"], r["removed"]) for r in got[1]] == [(text, [])]
    assert [(r["kept"], r["removed"]) for r in got[2]] == [("", [{"start": 0, "end": 20}])]


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = copies(seed)
    got = by_id(jaccard_join.similar_groups(frame(spark, rows)))
    sets = {i: ngrams(t, 5) for i, t in rows}
    want = components(sets, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, [r] in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_groups_query_over_a_table(spark, documents):
    sets = {r["doc_id"]: ngrams(r["text"], 5) for r in documents.collect()}
    want = components(sets, 80)
    got = by_id(registry.op3_similar_groups(spark, FOLDER))
    assert {i: (r["n_shingles"], r["component_id"]) for i, [r] in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_groups_with_common_ngrams_and_a_text_of_a_third_of_the_rows(spark):
    draw = random.Random(9)
    line = " ".join(f"common{n}" for n in range(40))
    rows = []
    for n in range(0, 600, 3):
        base = [f"w{n}x{k}" for k in range(40)]
        other = list(base)
        for at in draw.sample(range(40), draw.choice([0, 1, 2, 3])):
            other[at] = "changed"
        rows += [(n, f"{line} {' '.join(base)}"), (n + 1, f"{' '.join(other)} {line}"), (n + 2, f"{line} end")]
    sets = {i: ngrams(t, 5) for i, t in rows}
    want = components(sets, 80)
    df = frame(spark, rows).repartition(3)
    told = df.selectExpr("doc_id AS id", "text AS body").mapInArrow(jaccard_join._describe(5), jaccard_join._DESCRIBED)
    assert len(jaccard_join._common(told)) >= 36
    assert list(jaccard_join._copied(told).values()) == [2]
    got = by_id(jaccard_join.similar_groups(df))
    assert {i: (r["n_shingles"], r["component_id"]) for i, [r] in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert want[599] == 2 and len(set(want.values())) > 200


def test_groups_around_a_centre_that_does_not_reach_all(spark):
    """Many near copies of one text, some of which are near a copy and not the centre."""
    draw = random.Random(5)
    base = [f"b{n}" for n in range(150)]
    rows = [(0, " ".join(base))]
    for n in range(1, 120):
        text = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 4, 5, 6])):
            text[at] = f"n{n}x{at}"
        rows.append((n, " ".join(text)))
    sets = {i: ngrams(t, 5) for i, t in rows}
    want = components(sets, 80)
    assert len(set(want.values())) > 1
    got = by_id(jaccard_join.similar_groups(frame(spark, rows)))
    assert {i: r["component_id"] for i, [r] in got.items()} == want


def test_groups_of_odd_rows(spark, odd, none):
    assert jaccard_join.similar_groups(none).count() == 0
    got = by_id(jaccard_join.similar_groups(odd))
    assert [r["component_id"] for r in got[0]] == [0] and got[0][0]["n_shingles"] == 0
    assert sorted(r["component_id"] for r in got[3]) == [3, 3, 3]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got[None] if r["n_shingles"]) == [(1, 3)]
    assert got[101][0]["component_id"] == 7
    assert sum(map(len, got.values())) == odd.count()


def test_regions_divide_and_stay_exact(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    draw = np.random.default_rng(6)
    sets = []
    for group in range(12):
        base = draw.choice(10_000, 60, replace=False) + 10_000 * group
        for _ in range(9):
            other = base.copy()
            other[draw.choice(60, draw.integers(0, 9), replace=False)] = draw.choice(10_000, 1) + 10_000 * group
            sets.append(np.unique(other))
    sizes = np.array([len(s) for s in sets], dtype=float)
    got = {tuple(sorted(p)) for p in jaccard_join.near_pairs(sets, sizes, 80)}
    want = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    }
    assert got == want and want


def test_a_region_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 300)
    rows = copies(8, 80)
    want = components({i: ngrams(t, 5) for i, t in rows}, 80)
    got = by_id(jaccard_join.similar_groups(frame(spark, rows)))
    assert {i: r["component_id"] for i, [r] in got.items()} == want


def test_a_region_of_form_letters_is_compared_in_strips():
    letters = [np.concatenate([np.arange(42), 100 + 8 * n + np.arange(8)]) for n in range(6000)]
    letters[4000] = np.append(letters[10][:-1], 1_000_000)  # two pairs that are near
    letters[5999] = np.append(letters[4500][:-2], [1_000_001, 1_000_002])
    sizes = np.array([len(s) for s in letters], dtype=float)
    tracemalloc.start()
    got = {tuple(sorted(p)) for p in jaccard_join.near_pairs(letters, sizes, 80)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(10, 4000), (4500, 5999)}
    assert peak < 100_000_000  # one matrix of all pairs is 144 MB


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_strips_find_the_pairs_of_sets_of_all_sizes(monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "STRIP", 16)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 50)
    draw = np.random.default_rng(percent)
    sets = [np.sort(draw.choice(60, draw.integers(1, 60), replace=False)) for _ in range(60)]
    sets += [np.append(s[draw.random(len(s)) < 0.95], 100 + n) for n, s in enumerate(sets * 2)]
    sizes = np.array([len(s) for s in sets], dtype=float) + (np.arange(len(sets)) % 3 == 0)
    got = [tuple(sorted(p)) for p in jaccard_join.near_pairs(sets, sizes, percent)]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want


def test_a_region_of_many_small_sets_goes_to_many_blocks(spark, monkeypatch):
    rows = [(1, 0, 50, 0.0, True)] + [(n, 1, 50, 0.25, False) for n in range(2, 202)]
    distances = spark.createDataFrame(rows, "node bigint, pivot bigint, size bigint, far double, linked boolean")
    labels = spark.createDataFrame([(-1, -1)], "node bigint, least bigint")
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 20)
    dealt = jaccard_join._regions(distances, labels, 80).where("region = 1").collect()
    pairs = {(r["block_a"], r["block_b"]) for r in dealt}
    assert pairs == {(a, b) for a in range(10) for b in range(a, 10)}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7)]
    df = local_rows(spark, links, T.StructType().add("a", "long").add("b", "long"))
    got = {r["node"]: r["least"] for r in stars.components(df).collect()}
    assert got == {n: 0 for n in range(41)} | {n: 100 for n in range(100, 140)}
    assert stars.components(df.where("a = 7 AND b = 7")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-2**40, 2**40)), st.integers(5, 8))
def test_packing_round_trip(numbers, width):
    array = np.array(numbers, dtype=np.int64)
    assert packing.unpack(packing.pack(array)).tolist() == numbers
    hashes = array.astype(np.uint64) & np.uint64(2 ** (8 * width) - 1)
    assert packing.unpack_hashes(packing.pack_hashes(hashes, width), width).tolist() == hashes.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \né ", max_size=30), min_size=1, max_size=6), st.integers(1, 6))
def test_hashes_stand_for_words_and_windows(texts, size):
    hashes, counts = rolling.word_hashes([t.encode() for t in texts])
    split = [t.encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    assert len({*zip(hashes.tolist(), sum(split, []))}) == len(set(hashes.tolist())) == len(set(sum(split, [])))
    windows, many = rolling.window_hashes(hashes, counts, size)
    want = [tuple(w[a:a + size]) for w in split for a in range(len(w) - size + 1)]
    assert many.tolist() == [max(0, len(w) - size + 1) for w in split] and len(windows) == len(want)
    assert len(set(zip(windows.tolist(), want))) == len(set(want)) == len(set(windows.tolist()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=18), st.integers(1, 3))
def test_tiles_are_those_of_greedy_string_tiling(item, doc, least):
    seeds = [
        (i, d) for i in range(len(item) - least + 1) for d in range(len(doc) - least + 1)
        if item[i:i + least] == doc[d:d + least]
    ]
    got = decontamination.tiles(*map(np.array, zip(*seeds)), least) if seeds else []
    assert sorted(got) == sorted(string_tiles(item, doc, least))


def bench(spark, items):
    return local_rows(spark, items, T.StructType().add("item_id", "long").add("text", "string"))


def test_leaks_in_texts_and_items_that_repeat_themselves(spark):
    line = "which of the following is right"
    items = [(n, f"{line} {n} {line} {n + 1} {line} a{n} b{n} c{n} d{n} e{n} f{n}") for n in range(30)]
    texts = [(1, " ".join([line] * 400)), (2, f"{items[4][1]} {line} {items[7][1]}"), (3, "la " * 3000)]
    benchmark = frame(spark, items).selectExpr("doc_id AS item_id", "text")
    got = by_id(decontamination.find_leaks(frame(spark, texts), benchmark))
    for doc, text in texts:
        want = {}
        for item, body in items:
            covered = sum(n for _, _, n in string_tiles(body.split(), text.split()[:200], 5))
            if covered >= 0.5 * len(body.split()):
                want[item] = covered
        assert {h["item"]: h["covered"] for h in got[doc][0]["hits"]} == want


def test_leaks_whole_reordered_partial_and_absent(spark):
    item = " ".join(f"q{n}" for n in range(20))
    halves = item.split()[10:] + ["between", "them"] + item.split()[:10]
    docs = frame(spark, [
        (1, f"before, {item.upper()}! after"), (2, " ".join(halves)), (3, " ".join(item.split()[:9])),
        (4, "nothing of it"), (5, " ".join(item.split()[:11])), (6, " ".join(reversed(item.split()))), (7, "xx yes no xx"),
    ])
    items = bench(spark, [(1, item), (2, None), (None, item), (3, "..."), (4, "Yes, no"), (4, "Yes, no")])
    got = {i: [(h["item"], h["covered"], h["words"]) for h in r[0]["hits"]] for i, r in by_id(decontamination.find_leaks(docs, items)).items()}
    assert got == {1: [(1, 20, 20)], 2: [(1, 20, 20)], 3: [], 4: [], 5: [(1, 11, 20)], 6: [], 7: [(4, 2, 2), (4, 2, 2)]}
    blocks = decontamination.find_leaks(docs, items, block_bytes=40)
    assert {i: r[0]["hits"] for i, r in by_id(blocks).items()} == {i: r[0]["hits"] for i, r in by_id(decontamination.find_leaks(docs, items)).items()}


def test_leaks_query_against_tiling_every_pair(spark, documents):
    import re

    plain = lambda t: re.findall(r"[^\W_]+|_+(?!)", t.lower())
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {}
    for r in documents.collect():
        doc = plain(r["text"])
        grams = {tuple(doc[a:a + 5]) for a in range(len(doc) - 4)}
        hits = []
        for i, item in items:
            near = [a for a in range(len(item) - 4) if tuple(item[a:a + 5]) in grams]
            if len({a + k for a in near for k in range(5)}) * 2 >= len(item):
                if sum(n for _, _, n in string_tiles(item, doc, 5)) * 2 >= len(item):
                    hits.append(i)
        want[r["doc_id"]] = sorted(hits)
    got = by_id(registry.op2_find_leaks(spark, FOLDER))
    assert {i: sorted(r["items"]) for i, [r] in got.items()} == want
    assert sum(map(bool, want.values())) > 0


def test_leaks_of_odd_rows(spark, odd, none):
    items = bench(spark, [(1, "word"), (2, "la " * 6)])
    assert decontamination.find_leaks(none, items).count() == 0
    assert decontamination.find_leaks(odd, bench(spark, [])).where(F.size("hits") > 0).count() == 0
    found = decontamination.find_leaks(odd, items)
    assert found.columns == [c for c in odd.columns if c != "hits"] + ["hits"]
    got = by_id(found)
    assert [len(r["hits"]) for r in got[100]] == [0] and got[7][0]["hits"][0]["item"] == 2
    assert sorted(len(r["hits"]) for r in got[3]) == [0, 1, 1]
    assert sum(map(len, got.values())) == odd.count() and len(ODD) == 10


def _clashing(words, tag):
    """A text of so many words that the spreading bits of its hash are those of ``tag``."""
    for n in range(10**7):
        text = " ".join([f"v{words}x{n}", *(f"u{words}y{k}" for k in range(words - 1))])
        if zlib.crc32(text.encode()) & 0xFFFF == tag:
            return text
    raise AssertionError


def test_rows_of_one_key_are_told_apart_by_their_whole_text(spark):
    passage = " ".join(f"p{n}" for n in range(40))
    holder = " ".join(f"h{n}" for n in range(200)) + " " + passage
    tag = zlib.crc32(holder.encode()) & 0xFFFF
    short, clean = _clashing(30, tag), _clashing(260, tag)
    for key in (None, 7):
        rows = [(1, passage), (key, holder), (key, short), (key, clean), (key, clean)]
        got = sorted((len(r["kept"].split()), r["n_words"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
        assert got == sorted([(40, 40), (200, 240), (30, 30), (260, 260), (260, 260)])


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_with_null_and_repeated_keys_are_those_of_a_plain_search(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([None, 1, 2, 3, 4, n]), text) for n, text in copies(seed, 50)]
    order = lambda k: (k is None, k or 0)
    windows = lambda w: [tuple(w[a:a + 13]) for a in range(len(w) - 12)]
    first = {}
    for key, text in sorted(rows, key=lambda r: order(r[0])):
        for w in windows((text or "").split()):
            first.setdefault(w, key)
    want = []
    for key, text in rows:
        words = (text or "").split()
        gone = [False] * len(words)
        for a, w in enumerate(windows(words)):
            if order(first[w]) < order(key):
                gone[a:a + 13] = [True] * 13
        want.append((key, " ".join(w for w, g in zip(words, gone) if not g)))
    got = [(r["doc_id"], r["kept"]) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_typographic_signs_are_no_part_of_words(spark):
    items = [(1, "“yes” she said – the answer is forty two"), (2, "l’été à Paris était très beau")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, [
        (1, 'so "Yes" she said - the answer is forty two.'), (2, "l'été à Paris était très beau"), (3, "nothing of it"),
        (4, "«yes» she said — the «answer» is forty two"), (5, "ételà Pariséta"),
    ])
    found = by_id(decontamination.find_leaks(docs, benchmark))
    assert {i: [h["item"] for h in r[0]["hits"]] for i, r in found.items()} == {1: [1], 2: [2], 3: [], 4: [1], 5: []}


def test_large_regions_divide_again_in_spark(spark, monkeypatch):
    draw = random.Random(12)
    template = [f"t{n}" for n in range(120)]
    texts = []
    for kind in range(6):  # forms that share a template, most by kind, and near copies within a kind
        own = template[:90] + [f"k{kind}x{n}" for n in range(40)]
        for _ in range(40):
            text = own[:]
            for _ in range(draw.choice([1, 2, 9])):
                text[draw.randrange(len(text))] = f"r{draw.randrange(10**6)}"
            texts.append(" ".join(text))
    rows = list(enumerate(texts))
    want = components({i: ngrams(t, 5) for i, t in rows}, 80)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 30)
    divided = []
    real = jaccard_join._divided

    def counted(placed, sets, percent):
        out = real(placed, sets, percent)
        divided.append((placed.select("region").distinct().count(), out.select("region").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "_divided", counted)
    got = by_id(jaccard_join.similar_groups(frame(spark, rows)))
    assert {i: r[0]["component_id"] for i, r in got.items()} == want
    assert divided[0][1] >= divided[0][0] >= 5


def test_divided_regions_keep_near_sets_together(spark, monkeypatch):
    draw = random.Random(5)
    sets = {}
    kinds = [draw.sample(range(10**6), 40) for _ in range(4)]
    for n in range(400):
        base = draw.sample(kinds[n % 4], 40 - draw.randrange(7))
        sets[n] = set(base) | set(draw.sample(range(10**6), draw.randrange(4)))
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 25)
    table = spark.createDataFrame([(n, len(s), sorted(s)) for n, s in sets.items()], "node bigint, size bigint, tokens array<bigint>")
    placed = table.selectExpr("1L AS region", "node", "size", "node AS label", "true AS outside")
    regions = {}
    for r in jaccard_join._divided(placed, table, 80).collect():
        regions.setdefault(r["node"], set()).add(r["region"])
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(near) > 50 and len(set().union(*regions.values())) > 4
    assert all(regions[a] & regions[b] for a, b in near)
