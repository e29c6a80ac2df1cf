"""Jaccard join of documents as sets of word n-grams, in the metric space of the sets.

One minus the Jaccard similarity is a metric. Pivots divide the documents into
regions, the triangle inequality says which documents of a region can be near each
other, and regions that are too large divide again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.llm.components import components
from tellers.llm.packing import buckets_for, joined, pack, pack_hashes, runs, slices, unpack, unpack_hashes
from tellers.llm.rolling import scramble, window_hashes, word_hashes
from tellers.llm.text import whole_text
from tellers.operators.sizing import splittable_join
from tellers.session import cut, remove_cuts, settled

WORDS = 5
PERCENT = 80  # least similarity
HASH_BYTES = 6  # of each n-gram's hash, beside the bucket it chose
NGRAMS_AT_ONCE = 1 << 20
BLOCK_TOKENS = 500_000  # of the documents of a region that one task holds of either side
BLOCK_SETS = 8192  # and of its documents
STRIP = 512  # documents of a leaf that are compared with as many others at once
PAIRS_AT_ONCE = 1 << 20
LEAF = 256  # documents of a region that are compared without further pivots
PIVOTS = 8  # of a region that divides again
COMMON = 32  # one set of so many has an n-gram that is common
COMMON_LEAST = 8  # and so many of a portion at least, for the portion to name it
COPIED = 1024  # one row of so many has a text that is copied often
_BYTES_AT_ONCE = 1 << 20

_DESCRIBED = "id bigint, tag bigint, size bigint, node bigint, sets bigint, often array<struct<token:bigint,n:bigint>>"
_PACKED = "bucket int, part int, hashes binary, nodes binary, sizes binary, many binary"
_SHARED = "part int, nodes binary, sizes binary, many binary, tokens binary, spread binary"
_SETS = "node bigint, size bigint, tokens array<bigint>, keys int, central double"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def ngram_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams; a shorter text is one n-gram."""
    hashes, counts = word_hashes([t.translate(_LOWER) for t in texts])
    windows, many = window_hashes(hashes, counts, words)
    ends, word_ends = np.cumsum(many), np.cumsum(counts)
    for n, m, end, word_end in zip(counts.tolist(), many.tolist(), ends.tolist(), word_ends.tolist()):
        if m:
            yield np.unique(windows[end - m:end])
        elif n:
            short = hashlib.md5(hashes[word_end - n:word_end].tobytes()).digest()
            yield np.frombuffer(short[:8], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def _node(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = scramble(found).sum() + np.uint64(len(found))
    return int(scramble(np.array([total]))[0].astype(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """(batch, first row, texts) of about ``_BYTES_AT_ONCE``."""
    for batch in batches:
        at, bodies = 0, batch.column(column)
        while at < batch.num_rows:
            taken, size, first = [], 0, at
            while at < batch.num_rows and size < _BYTES_AT_ONCE:
                taken.append(bodies[at].as_py().encode("utf-8", "surrogatepass"))
                size += len(taken[-1])
                at += 1
            yield batch, first, taken


def _describe(words: int):
    """Task function: each document's set, by its size and name.

    The first row of a portion also has the number of its different sets and those
    n-grams that one of ``COMMON`` of them has, with the number of sets.
    """
    often_type = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, texts in _texts(batches, 1):
            sets = list(ngram_sets(texts, words))
            names = list(map(_node, sets))
            different = {name: found for name, found in zip(names, sets) if len(found)}
            token, n = np.unique(joined(different.values(), np.uint64), return_counts=True)
            named = n >= max(COMMON_LEAST, len(different) / COMMON)
            often = [{"token": t, "n": k} for t, k in zip(token[named].astype(np.int64).tolist(), n[named].tolist())]
            rest = [None] * (len(texts) - 1)
            tags = batch.column(2).slice(first, len(texts)) if batch.num_columns > 2 else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(texts)), tags, pa.array(map(len, sets), pa.int64()), pa.array(names, pa.int64()),
                    pa.array([len(different), *rest], pa.int64()), pa.array([often, *rest], often_type),
                ],
                ["id", "tag", "size", "node", "sets", "often"],
            )

    return run


def _common(described: DataFrame) -> np.ndarray:
    """The sorted hashes of n-grams that at least one of ``COMMON`` sets has.

    A portion does not name an n-gram that fewer of its sets have, so one that twice
    as many sets have over all is found. They are at most ``COMMON`` times the mean
    size of a set, however many rows there are.
    """
    sets = described.agg(F.sum("sets")).first()[0] or 0
    named = described.select(F.inline("often")).groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(named.where(F.col("n") * COMMON >= sets).select("token").toArrow()["token"].to_numpy().astype(np.uint64))


def _copied(described: DataFrame) -> dict[int, int]:
    """The least key of each set that one of ``COPIED`` rows has, ``COPIED`` sets at most."""
    counted = described.where("size > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    rows = described.count()
    often = counted.where((F.col("n") > 1) & (F.col("n") * COPIED >= rows) & F.col("least").isNotNull())
    return {row["node"]: row["least"] for row in often.select("node", "least").collect()}


def _spread(buckets: int, words: int, common: Broadcast, copied: Broadcast):
    """Task function: n-grams of a task's sets, as packed rows by bucket, equal sets once.

    Nobody needs to be asked about a common n-gram: it is shared and comes last in
    order. It does not go to its bucket, where it would gather a row of most sets, but
    with its set's name to the set's part. A set that is copied often is sent by the row
    with the least key only.
    """

    def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes, sizes = np.array(list(sets), dtype=np.int64), np.array([len(x) for x in sets.values()])
        value = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(nodes)), sizes)
        rows = []
        at = np.searchsorted(common.value, value)
        known = np.append(common.value, np.uint64(0))[at] == value
        known[at == len(common.value)] = False
        part = nodes[owner[known]] % buckets
        order = np.argsort(part, kind="stable")
        shared, of_shared = value[known][order], owner[known][order]
        for p, start, end in slices(part[order]):
            of, many = runs(of_shared[start:end])
            rows.append((p, p, shared[start:end].tobytes(), nodes[of].tobytes(), pack(sizes[of]), pack(many)))
        value, owner = value[~known], owner[~known]
        bucket = ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # by the upper bits
        order = np.argsort(bucket, kind="stable")
        value, owner, bucket = value[order], owner[order], bucket[order]
        for b, start, end in slices(bucket):
            of, many = runs(owner[start:end])
            rows.append((b, None, pack_hashes(value[start:end], HASH_BYTES), nodes[of].tobytes(), pack(sizes[of]), pack(many)))
        return _batch(rows, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch, first, texts in _texts(batches, 1):
            keys = batch.column(0).slice(first, len(texts)).to_pylist()
            for key, found in zip(keys, ngram_sets(texts, words)):
                node = _node(found)
                if len(found) and node not in held and copied.value.get(node, key) == key:
                    held[node] = found
                    size += len(found)
            if size >= NGRAMS_AT_ONCE:
                yield flush(held)
                held, size = {}, 0
        if size:
            yield flush(held)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.binary() if kind == "binary" else pa.int32() for _, kind in fields]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], [name for name, _ in fields])


def _share(parts: int):
    """Group function: n-grams of one bucket that two different sets have, with how many do."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = [  # common n-grams, on their way to their sets
            (part, nodes, sizes, many, tokens, b"\xff" * (len(tokens) // 8))
            for part, nodes, sizes, many, tokens in zip(*(table[c].to_pylist() for c in ("part", "nodes", "sizes", "many", "hashes")))
            if part is not None
        ]
        table = table.filter(pc.is_null(table["part"]))
        value = joined((unpack_hashes(x.as_py(), HASH_BYTES) for x in table["hashes"]), np.uint64)
        many = joined((unpack(x.as_py()) for x in table["many"]), np.int64)
        nodes = joined((np.frombuffer(x.as_py(), np.int64) for x in table["nodes"]), np.int64)
        sizes = joined((unpack(x.as_py()) for x in table["sizes"]), np.int64)
        row = np.repeat(np.arange(len(many), dtype=np.int32), many)
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        same = value[1:] == value[:-1]
        repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(value) else np.empty(0, bool)
        value, row = value[repeated], row[repeated]
        order = np.lexsort((nodes[row], value))
        value, row = value[order], row[order]
        node = nodes[row]
        first = np.ones(len(value), dtype=bool)
        first[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])  # of equal sets from several portions, one
        value, row, node = value[first], row[first], node[first]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
        of = np.diff(np.append(starts, len(value)))
        spread = np.repeat(np.minimum(255, np.floor(8 * np.log2(np.maximum(of, 1)))), of).astype(np.uint8)
        kept = np.repeat(of > 1, of)
        value, row, node, spread = value[kept], row[kept], node[kept], spread[kept]
        token = (value | np.uint64((bucket & 0xFFFF) << 48)).astype(np.int64)
        part = node % parts
        order = np.lexsort((node, part))
        token, row, node, spread, part = token[order], row[order], node[order], spread[order], part[order]
        for p, a, b in slices(part):
            of_node, count = runs(node[a:b])
            size = sizes[row[a:b]][np.cumsum(count) - count]
            rows.append((p, of_node.tobytes(), pack(size), pack(count), token[a:b].tobytes(), spread[a:b].tobytes()))
        return pa.Table.from_batches([_batch(rows, _SHARED)])

    return run


def _gather(percent: int):
    """Group function: the sets of one part of which enough is shared to be near another.

    The tokens of a set are those that other sets have too, the rarest first.
    ``keys`` of them suffice: two sets that are near share one of these.
    """

    def run(table: pa.Table) -> pa.Table:
        column = {c: [x.as_py() for x in table[c]] for c in ("nodes", "sizes", "many", "tokens", "spread")}
        nodes = joined((np.frombuffer(x, np.int64) for x in column["nodes"]), np.int64)
        sizes = joined((unpack(x) for x in column["sizes"]), np.int64)
        many = joined((unpack(x) for x in column["many"]), np.int64)
        tokens = joined((np.frombuffer(x, np.int64) for x in column["tokens"]), np.int64)
        spread = joined((np.frombuffer(x, np.uint8) for x in column["spread"]), np.uint8)
        node = np.repeat(nodes, many)
        order = np.lexsort((tokens, spread, node))
        tokens, spread, node = tokens[order], spread[order], node[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (tokens[1:] != tokens[:-1])  # of equal sets from several portions, one
        tokens, spread, node = tokens[new], spread[new], node[new]
        names, first, count = np.unique(node, return_index=True, return_counts=True)
        by_name = dict(zip(nodes.tolist(), sizes.tolist()))
        out: dict[str, list] = {"node": [], "size": [], "tokens": [], "keys": [], "central": []}
        for name, a, n in zip(names.tolist(), first.tolist(), count.tolist()):
            size = by_name[name]
            least = -(-percent * size // 100)
            if n >= least:
                out["node"].append(name)
                out["size"].append(size)
                out["tokens"].append(tokens[a:a + n])
                out["keys"].append(n - least + 1)
                out["central"].append(float(spread[a:a + n].sum(dtype=np.int64)) / size)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.float64())
        return pa.Table.from_arrays([pa.array(v, type=k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def _near(shared: Column, one: Column, other: Column, percent: int) -> Column:
    return shared * 100 >= (one + other - shared) * percent


def _pivots(sets: DataFrame, percent: int) -> DataFrame:
    """(node, pivot, size, pivot_size, far): each set's distance to the pivots it may belong to.

    Each key's pivot is the most central of the sets with that key, the one whose
    tokens most other sets have. So each key gives a set one pivot, and two near sets
    have a pivot in common.
    """
    keyed = sets.select("node", "size", "central", F.explode(F.slice("tokens", F.lit(1), F.col("keys"))).alias("key"))
    best = F.struct("central", -F.col("node"))
    of_key = keyed.groupBy("key").agg(
        F.max_by(F.struct(F.col("node").alias("pivot"), F.col("size").alias("pivot_size")), best).alias("of"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("key", "of.*")
    pairs = splittable_join(keyed.select("key", "node", "size"), of_key, ["key"], "inner").where("node <> pivot").select(
        "node", "size", "pivot", "pivot_size"
    ).distinct()
    tokens = sets.select("node", "tokens")
    with_own = pairs.join(tokens, "node")
    both = with_own.join(tokens.select(F.col("node").alias("pivot"), F.col("tokens").alias("pivot_tokens")), "pivot")
    shared = F.size(F.array_intersect("tokens", "pivot_tokens")).cast("long")
    measured = both.select("node", "pivot", "size", "pivot_size", shared.alias("shared"))
    return measured.select(
        "node", "pivot", "size", (1 - F.col("shared") / (F.col("size") + F.col("pivot_size") - F.col("shared"))).alias("far"),
        _near(F.col("shared"), F.col("size"), F.col("pivot_size"), percent).alias("linked"),
    )


def _divided(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of (region, node, size, ...) with regions larger than a block divided, as often as that helps.

    Some sets of a region become its pivots. Each set goes to the region of its nearest
    pivot, and to each other whose pivot is at most two radii farther, so two near sets
    have a region in common: see ``near_pairs``. A region of which a part keeps more
    than three quarters is left whole and dealt to blocks. Each turn is a written table.
    """
    radius = 1 - percent / 100 + 1e-9
    todo, done = cut(placed), []
    for turn in itertools.count():
        sizes = todo.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
        large = cut(sizes.where((F.col("n") > BLOCK_SETS) | (F.col("tokens") > BLOCK_TOKENS)).select("region", F.col("n").alias("whole")))
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, todo])
        chosen = splittable_join(todo, large, ["region"], "inner")
        first = W.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        named = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS)
        tokens = sets.select("node", "tokens")
        pivots = named.select("region", "node", "size").join(tokens, "node").groupBy("region").agg(
            F.collect_list(F.struct("node", "size", "tokens")).alias("pivots")  # PIVOTS at most
        )
        measured = splittable_join(chosen.join(tokens, "node"), pivots, ["region"], "inner")

        def far(pivot: Column) -> Column:
            shared = F.size(F.array_intersect(F.col("tokens"), pivot["tokens"]))
            return F.struct((1 - shared / (F.col("size") + pivot["size"] - shared)).alias("far"), pivot["node"].alias("pivot"))

        apart = measured.withColumn("apart", F.transform("pivots", far)).drop("tokens", "pivots")
        near = F.filter("apart", lambda p: p["far"] <= F.array_min("apart")["far"] + 2 * radius)
        parts = cut(apart.withColumn("reach", near).withColumn("pivot_of", F.explode("reach")).withColumn(
            "part", F.xxhash64("region", "pivot_of.pivot")).drop("apart", "reach", "pivot_of"))
        most = parts.groupBy("region", "part", "whole").agg(F.count(F.lit(1)).alias("n")).groupBy("region", "whole").agg(F.max("n").alias("most"))
        helped = cut(most.where(F.col("most") <= 0.75 * F.col("whole")).select("region"))
        left_whole = large.join(helped, "region", "left_anti").select("region")
        done.append(splittable_join(todo, large.select("region"), ["region"], "left_anti").select(*placed.columns))
        done.append(splittable_join(todo, left_whole, ["region"], "left_semi").select(*placed.columns))
        todo = cut(splittable_join(parts, helped, ["region"], "left_semi").drop("region", "whole").withColumnRenamed("part", "region").select(*placed.columns))


def _regions(distances: DataFrame, labels: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """(region, block_a, block_b, node, side): the parts of regions that are still to compare.

    A region holds the sets that have its pivot. Its core is what is known to be
    connected with the pivot; what may be missing are links of the sets outside the
    core, among them or with the core. By the triangle inequality a set of the core
    can only be near one outside if it is at most the radius nearer to the pivot.
    A region that is larger than a block is divided by pivots of its own among ``sets``;
    what they do not divide is dealt to blocks by hash, so that a task has two blocks of bounded
    size whatever the region's.
    """
    radius = 1 - percent / 100 + 1e-9
    label = labels.select(F.col("node").alias("of"), F.col("least").alias("label"))
    inside = distances.select("node", "pivot", "size", "far").join(label, F.col("node") == F.col("of"), "left").drop("of")
    inside = inside.withColumn("label", F.coalesce("label", "node"))
    of_pivot = label.select(F.col("of").alias("pivot_of"), F.col("label").alias("pivot_label"))
    placed = inside.join(of_pivot, F.col("pivot") == F.col("pivot_of"), "left").drop("pivot_of")
    placed = placed.withColumn("outside", F.col("label") != F.coalesce("pivot_label", "pivot"))
    stats = placed.groupBy("pivot").agg(
        F.min(F.when(F.col("outside"), F.col("far"))).alias("nearest"),
        F.sum(F.when(F.col("outside"), F.col("size"))).alias("tokens_outside"), F.sum("size").alias("tokens"),
        F.count_if("outside").alias("n_outside"), F.count(F.lit(1)).alias("n"),
    ).where("n_outside > 0")
    # the pivot itself has been compared with all of them
    kept = splittable_join(placed, stats, ["pivot"], "inner").where(
        F.col("outside") | (F.col("far") >= F.col("nearest") - radius)
    ).where("n_outside > 1 OR tokens > tokens_outside")
    kept = kept.select(F.col("pivot").alias("region"), "node", "size", "label", "outside")
    if sets is not None:
        kept = _divided(kept, sets, percent)
    counts = kept.groupBy("region").agg(
        F.sum(F.when(F.col("outside"), F.col("size"))).alias("tokens_outside"), F.sum("size").alias("tokens"),
        F.count_if("outside").alias("n_outside"), F.count(F.lit(1)).alias("n"),
    ).where("n_outside > 0")
    kept = splittable_join(kept, counts, ["region"], "inner").where("n_outside > 1 OR tokens > tokens_outside")
    blocks_out = F.ceil(F.greatest(F.col("tokens_outside") / BLOCK_TOKENS, F.col("n_outside") / BLOCK_SETS))
    blocks_in = F.ceil(F.greatest((F.col("tokens") - F.col("tokens_outside")) / BLOCK_TOKENS, (F.col("n") - F.col("n_outside")) / BLOCK_SETS))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), blocks_out)).otherwise(F.pmod(F.xxhash64("node"), F.greatest(blocks_in, F.lit(1))) + blocks_out)
    # a set outside meets all blocks outside and in the core; one of the core those outside
    others = F.when(F.col("outside"), F.sequence(F.lit(0).cast("long"), blocks_out + blocks_in - 1)).otherwise(F.sequence(F.lit(0).cast("long"), blocks_out - 1))
    dealt = kept.select("region", "node", "label", "outside", own.alias("own"), F.explode(others).alias("other"))
    return dealt.select(
        "region", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
        "node", "label", "outside",
    )


def _places(start: np.ndarray, chosen: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``chosen``, place) of the first ``many`` tokens of each chosen set."""
    row = np.repeat(np.arange(len(chosen)), many)
    return row, np.arange(len(row)) + np.repeat(start[chosen] - (np.cumsum(many) - many), many)


def _overlaps(row: np.ndarray, token: np.ndarray, other_row: np.ndarray, other_token: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sizes of the intersections of some sets with some others, as a matrix of ``shape``."""
    both = np.intersect1d(token, other_token)
    here, there = np.isin(token, both), np.isin(other_token, both)
    row, column = row[here], np.searchsorted(both, token[here])
    other_row, other_column = other_row[there], np.searchsorted(both, other_token[there])
    often, other_often = np.bincount(column, minlength=len(both)), np.bincount(other_column, minlength=len(both))
    out = np.zeros(shape, dtype=np.float32)
    frequent = np.flatnonzero(often * other_often * STRIP > shape[0] * shape[1])
    place = np.full(len(both), -1)
    place[frequent] = np.arange(len(frequent))
    for start in range(0, len(frequent), 2048):  # tokens of many sets as a matrix product
        end = min(start + 2048, len(frequent))
        dense = []
        for n, r, c in ((shape[0], row, place[column]), (shape[1], other_row, place[other_column])):
            chosen = (c >= start) & (c < end)
            dense.append(np.zeros((n, end - start), dtype=np.float32))
            dense[-1][r[chosen], c[chosen] - start] = 1
        out += dense[0] @ dense[1].T
    rare = np.flatnonzero(place[column] < 0)  # the others pair by pair
    order = np.argsort(other_column, kind="stable")
    first = np.searchsorted(other_column[order], np.arange(len(both)))
    ends = np.cumsum(other_often[column[rare]])
    at = 0
    while at < len(rare):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        of, place_there = _places(first, column[rare[at:upto]], other_often[column[rare[at:upto]]])
        flat = row[rare[at:upto]][of] * shape[1] + other_row[order[place_there]]
        out += np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape)
        at = upto
    return out


def _compare(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of near sets, each once, of a region that is compared in whole.

    The sets go by size in strips of ``STRIP``, two of which meet at a time. Near sets
    of two strips have ``need`` tokens in common at least, by the least sizes in
    them. So a set of which fewer tokens occur in other sets here is left out, and so is
    one that shares none of its ``n - need + 1`` rarest tokens with the other strip.
    """
    by_size = np.argsort(sizes, kind="stable")
    size = sizes[by_size]
    column = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), [len(sets[i]) for i in by_size])
    often = np.bincount(column)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    kept = often[column] > 1
    row, token = row[kept], rank[column[kept]]
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    many = np.bincount(row, minlength=len(sets))
    start = np.cumsum(many) - many
    for a in range(0, len(sets), STRIP):
        one = np.arange(a, min(a + STRIP, len(sets)))
        for b in range(a, len(sets), STRIP):
            if 100 * size[one[-1]] < percent * size[b]:
                break
            other = np.arange(b, min(b + STRIP, len(sets)))
            need = max(1, int(-(-percent * (size[a] + size[b]) // (100 + percent))))
            left, right = one[many[one] >= need], other[many[other] >= need]
            if a != b:
                of_left, at_left = _places(start, left, many[left] - need + 1)
                of_right, at_right = _places(start, right, many[right] - need + 1)
                left, right = (
                    left[np.unique(of_left[np.isin(token[at_left], token[at_right])])],
                    right[np.unique(of_right[np.isin(token[at_right], token[at_left])])],
                )
            if not len(left) or not len(right):
                continue
            of_left, at_left = _places(start, left, many[left])
            of_right, at_right = _places(start, right, many[right])
            shared = _overlaps(of_left, token[at_left], of_right, token[at_right], (len(left), len(right))).astype(np.float64)
            total = size[left][:, None] + size[right][None, :] - shared
            near = 100 * shared >= percent * total
            x, y = np.nonzero(np.triu(near, 1) if a == b else near)
            yield from zip(by_size[left[x]].tolist(), by_size[right[y]].tolist())


def near_pairs(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of near sets, a pair once or more; regions divide until they are leaves.

    Each set goes to the region of its nearest pivot, and to each other region whose
    pivot is at most two radii farther: if x's nearest pivot is p and y is near x,
    then d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r for each q. A region
    that its pivots do not divide is compared in whole, strip by strip.
    """
    radius = 1 - percent / 100 + 1e-9
    todo = [np.arange(len(sets))]
    while todo:
        chosen = todo.pop()
        if len(chosen) > LEAF:
            pivots = chosen[:: max(1, len(chosen) // PIVOTS)][:PIVOTS]
            far = np.empty((len(chosen), len(pivots)))
            for k, p in enumerate(pivots):
                shared = np.array([np.isin(sets[i], sets[p], assume_unique=True).sum() for i in chosen])
                far[:, k] = 1 - shared / (sizes[chosen] + sizes[p] - shared)
            reach = far <= far.min(axis=1, keepdims=True) + 2 * radius
            if reach.sum(axis=0).max() <= 0.75 * len(chosen):
                todo += [chosen[reach[:, k]] for k in range(len(pivots))]
                continue
        for i, j in _compare([sets[i] for i in chosen], sizes[chosen], percent):
            yield int(chosen[i]), int(chosen[j])


def _join_region(percent: int):
    """Group function: links between the sets of two blocks of a region, as many as connect."""

    def run(table: pa.Table) -> pa.Table:
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        outside = table["outside"].to_pylist()
        sizes = table["size"].to_numpy().astype(np.float64)
        sets = [np.asarray(x.values, dtype=np.int64) for x in table["tokens"]]
        top = {label: label for label in labels}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        links = []
        for i, j in near_pairs(sets, sizes, percent):
            a, b = find(labels[i]), find(labels[j])
            if a != b and (outside[i] or outside[j]):
                top[a] = b
                links.append((nodes[i], nodes[j]))
        a, b = zip(*links) if links else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", details: bool = False
) -> DataFrame:
    """For each row: key, n_shingles, component_id, the least key that links reach.

    With ``details`` also ``text_tag``, a 64-bit hash of the text, and ``component``, a
    number that the rows of a component share, NULL for an empty set: they tell rows and
    components apart where a key is NULL or names several texts.

    A document is the set of its n-grams of ``words`` words, in lower case for A to Z.
    Two link when 100 times the size of the intersection is at least ``percent`` times
    that of the union. The steps:

    1. Equal sets are one node. A set of which others share less than ``percent`` of
       the n-grams is farther than the radius from all others and needs no region.
       N-grams that many sets have, and texts that many rows have, are known
       beforehand, so that neither gathers in a bucket.
    2. Each of the rarest n-grams of the rest names a pivot; two near sets have a
       pivot in common. Distances to pivots are exact and give the first links.
    3. A region whose sets these links do not connect is joined: the triangle
       inequality drops what cannot be near, further pivots divide it, in Spark while
       it is larger than a block and in a task then, and leaves are compared exactly.

    Links are found by hashes of n-grams, of which two in one pair of documents are
    the same by chance once in some 10**10 pairs of usual length. A text with fewer
    words is one n-gram; an empty or NULL text is the empty set, linked with nothing,
    its own component. Rows with a NULL key link as others do, but a component has no
    name from them: it is NULL if no row of it has a key. Repeated rows and keys each
    give a row; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole_text(F.col(f"`{text}`")).alias("body"))
    tagged = rows.withColumn("tag", F.xxhash64("body"))
    told = cut(tagged.mapInArrow(_describe(words), _DESCRIBED))
    described = told.select("id", "tag", "size", "node")
    buckets = buckets_for(rows, F.col("body"))
    context = docs.sparkSession.sparkContext
    spread = _spread(buckets, words, context.broadcast(_common(told)), context.broadcast(_copied(described)))
    packed = rows.mapInArrow(spread, _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_share(buckets), _SHARED)
    sets = cut(shared.groupBy("part").applyInArrow(_gather(percent), _SETS))

    def reached() -> DataFrame:
        distances = cut(_pivots(sets, percent))
        links = distances.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        dealt = _regions(distances, cut(components(links)), percent, sets)
        loaded = dealt.join(sets.select("node", "size", "tokens"), "node")
        more = loaded.groupBy("region", "block_a", "block_b").applyInArrow(_join_region(percent), "a bigint, b bigint")
        return components(links.unionByName(more))

    labels = settled(reached)
    remove_cuts(sets)

    nodes = described.where("size > 0").groupBy("node").agg(F.min("id").alias("least_id"))
    named = nodes.join(labels, "node", "left").withColumn("least", F.coalesce("least", "node"))
    names = named.groupBy("least").agg(F.min("least_id").alias("component_id"))
    by_node = splittable_join(named.select("node", "least"), names, ["least"], "inner").select("node", "least", "component_id")
    full = splittable_join(described if details else described.drop("tag"), by_node, ["node"], "left")
    return full.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *([F.col("tag").alias("text_tag"), F.when(F.col("size") > 0, F.col("least")).alias("component")] if details else []),
    )
