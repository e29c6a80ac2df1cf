"""Substring deduplication: windows of words that an earlier document has, removed."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.packing import buckets_for, joined, pack, pack_hashes, runs, slices, unpack, unpack_hashes
from tellers.llm.rolling import OTHER_BASE, window_hashes, word_hashes
from tellers.llm.text import whole_text

WINDOW = 13
HASH_BYTES = 7  # of each window's hash, beside an independent one that chose its bucket
WINDOWS_AT_ONCE = 1 << 20
_BYTES_AT_ONCE = 1 << 20
_LAST = np.iinfo(np.int64).max  # stands for a NULL key, after all others

_PACKED = "part int, kind int, hashes binary, keys binary, tags binary, many binary, places binary"
_MARKED = "part int, keys binary, tags binary, many binary, places binary"
_SPREAD = 0xFFFF  # the bits of a tag that place a row without a key, or with the same one


def _tag(body: bytes, wide: bool) -> int:
    """Tells rows apart that share a key but not a text, with ``wide`` by 63 bits."""
    near = zlib.crc32(body) & _SPREAD
    return int.from_bytes(hashlib.md5(body).digest()[:8]) >> 17 << 16 | near if wide else near


def _marks_of(keys: np.ndarray, tags: np.ndarray, places: np.ndarray, parts: int) -> Iterator[tuple]:
    """Window starts to remove, as packed rows by the part of the table their document is in."""
    part = (keys % parts + (tags & _SPREAD)) % parts
    order = np.lexsort((places, tags, keys, part))
    keys, tags, places, part = keys[order], tags[order], places[order], part[order]
    for p, a, b in slices(part):
        new = np.flatnonzero((np.diff(keys[a:b]) != 0) | (np.diff(tags[a:b]) != 0)) + 1
        starts = np.concatenate([[0], new])
        many = np.diff(np.append(starts, b - a))
        yield p, pack(keys[a:b][starts]), pack(tags[a:b][starts]), pack(many), pack(places[a:b])


def _spread(buckets: int, parts: int, window: int, wide: bool):
    """Task function: windows of a task's documents as packed rows, by bucket."""

    def flush(hashes: list, others: list, keys: list, tags: list, counts: list) -> Iterator[tuple]:
        value, other = joined(hashes, np.uint64), joined(others, np.uint64)
        counts = np.array(counts, dtype=np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys, tags = np.array(keys, dtype=np.int64), np.array(tags, dtype=np.int64)
        key = keys[row]
        # of a window here more than once, only the first document asks the others
        order = np.lexsort((key, other, value))
        new = np.concatenate([[True], (np.diff(value[order]) != 0) | (np.diff(other[order]) != 0)])
        least = key[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(value), dtype=bool)
        later[order] = key[order] > least
        for p, *columns in _marks_of(key[later], tags[row[later]], place[later], parts):
            yield p % buckets, 1, pack(np.array([p])), *columns
        asking = np.flatnonzero(~later)
        bucket = (other[asking] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        asking, bucket = asking[order], bucket[order]
        for b, start, end in slices(bucket):
            chosen = asking[start:end]
            owner, many = runs(row[chosen])
            yield (
                b, 0, pack_hashes(value[chosen], HASH_BYTES), pack(keys[owner]), pack(tags[owner]), pack(many), pack(place[chosen])
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            bodies = batch.column(1)
            at = 0
            while at < len(keys):
                upto, taken, length = at, [], 0
                while upto < len(keys) and length < _BYTES_AT_ONCE:
                    taken.append(bodies[upto].as_py().encode("utf-8", "surrogatepass"))
                    length += len(taken[-1])
                    upto += 1
                words, counts = word_hashes(taken)
                value, many = window_hashes(words, counts, window)
                other, _ = window_hashes(words, counts, window, OTHER_BASE)
                held[0].append(value)
                held[1].append(other)
                held[2].extend(_LAST if k is None else k for k in keys[at:upto])
                held[3].extend(_tag(body, wide) for body in taken)
                held[4].extend(many.tolist())
                size += len(value)
                at = upto
                if size >= WINDOWS_AT_ONCE:
                    yield _batch(flush(*held), _PACKED)
                    held, size = ([], [], [], [], []), 0
        if size:
            yield _batch(flush(*held), _PACKED)

    return run


def _batch(rows: Iterator[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.binary() if kind == "binary" else pa.int32() for _, kind in fields]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], [name for name, _ in fields])


def _settle(parts: int):
    """Group function: windows of one bucket that a smaller key has too, as marks."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        rows = [i for i, kind in enumerate(kinds) if kind == 0]
        ready = [i for i, kind in enumerate(kinds) if kind == 1]
        out = [
            (int(unpack(table["hashes"][i].as_py())[0]), *(table[c][i].as_py() for c in ("keys", "tags", "many", "places")))
            for i in ready
        ]
        column = {c: table[c].take(pa.array(rows, pa.int64())) for c in ("hashes", "keys", "tags", "many", "places")}
        value = joined((unpack_hashes(x.as_py(), HASH_BYTES) for x in column["hashes"]), np.uint64)
        many = joined((unpack(x.as_py()) for x in column["many"]), np.int64)
        row = np.repeat(np.arange(len(many), dtype=np.int32), many)
        keys = joined((unpack(x.as_py()) for x in column["keys"]), np.int64)
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(value) else np.empty(0, bool)
        order, value = order[repeated], value[repeated]
        if len(order):
            key = keys[row[order]]
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            least = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(key))))
            later = order[key > least]
            tags = joined((unpack(x.as_py()) for x in column["tags"]), np.int64)
            places = joined((unpack(x.as_py()) for x in column["places"]), np.int64)
            out += _marks_of(keys[row[later]], tags[row[later]], places[later], parts)
        return pa.Table.from_batches([_batch(iter(out), _MARKED)])

    return run


def _remove(window: int, key_type: pa.DataType, wide: bool):
    """Cogroup function: documents of one part with their marks."""
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for i in range(marks.num_rows):
            keys, tags, many, places = (unpack(marks[c][i].as_py()) for c in ("keys", "tags", "many", "places"))
            for key, tag, found in zip(keys.tolist(), tags.tolist(), np.split(places, np.cumsum(many)[:-1])):
                starts.setdefault((key, tag), []).append(found)
        n_words, removed, kept = [], [], []
        for key, body in zip(docs["id"], docs["body"]):
            body = body.as_py().encode("utf-8", "surrogatepass")
            words = body.split()  # of bytes, so at ASCII spaces only
            n_words.append(len(words))
            key = key.as_py()
            found = starts.get((_LAST if key is None else key, _tag(body, wide))) if starts else None
            spans = []
            if found:
                edges = np.zeros(len(words) + window + 1, dtype=np.int64)
                at = np.unique(np.concatenate(found))
                edges[at] += 1
                edges[at + window] -= 1
                covered = np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8)
                change = np.diff(covered)
                spans = list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))
                for a, b in reversed(spans):
                    del words[a:b]
            removed.append([{"start": a, "end": b} for a, b in spans])
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.Table.from_arrays(
            [docs["id"].cast(key_type), pa.array(n_words, pa.int64()), pa.array(removed, type=interval), pa.array(kept, pa.string())],
            ["id", "n_words", "removed", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_words, removed, kept.

    A word is a run of characters other than ASCII spaces. A window of ``window``
    words is repeated if the same words start somewhere in a row with a smaller key;
    all windows are judged on the input. ``removed`` holds the maximal intervals of
    words, from start up to but without end, that repeated windows cover, and
    ``kept`` the other words joined by single blanks.

    Every window gets a Karp-Rabin hash. The hashes are dealt to buckets, packed;
    each bucket finds the smallest key of each hash, and the windows with a larger
    key go back to their documents as marks. A portion of documents sends a window
    once, however often it has it, so the copies of one passage do not gather in one
    bucket. Two hashes count, one of 64 bits for the bucket and 56 bits of an
    independent one within it: two different windows pass for equal with a chance of
    about one in 10**11 for each window, at any size of the table.

    NULL texts are empty. A NULL key is larger than any other, and rows with equal
    keys do not remove each other's words. Where a key is NULL or repeated, windows and
    marks carry 63 bits of a hash of the row's text, so that the rows are told apart;
    else the key alone says which row is meant. Keys are whole numbers. Other columns are
    ignored; an empty table gives no rows.
    """
    body = whole_text(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("body"))
    buckets = parts = buckets_for(rows, F.col("body"))
    keys = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    wide = not keys.where("id IS NULL OR n > 1").isEmpty()
    packed = rows.mapInArrow(_spread(buckets, parts, window, wide), _PACKED)
    marks = packed.groupBy("part").applyInArrow(_settle(parts), _MARKED)
    # the tag spreads rows without a key, or with the same one
    tag = F.crc32(F.col("body").cast("binary")).bitwiseAND(F.lit(_SPREAD))
    part = F.pmod(F.pmod(F.coalesce("id", F.lit(int(_LAST))), F.lit(parts)) + tag, F.lit(parts)).cast("int")
    placed = rows.withColumn("part", part)
    interval = T.StructType().add("start", "long").add("end", "long")
    schema = T.StructType().add("id", "long").add("n_words", "long").add("removed", T.ArrayType(interval)).add("kept", "string")
    result = placed.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_remove(window, pa.int64(), wide), schema)
    return result.withColumnRenamed("id", key)
