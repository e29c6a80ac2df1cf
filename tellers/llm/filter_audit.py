"""Filter interaction audit: what each filter removes, before and after each of the others.

Failing documents are kept as sorted posting lists, one a filter for each part and range
of ids. Unions of lists and what a list has besides a union are found by merges that
gallop: a run of the shorter list looks for its window in the longer one by steps that
double, from where the run before it ended. Sizes add up over ranges, so no list is ever
longer than one range, whatever the number of documents of a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.text import SPACES, whole_text
from tellers.operators.sizing import splittable_join
from tellers.session import cut, remove_cuts

REPEATED = "E"  # the filter that is not a condition on one text alone
_RUN = 256  # ids of the shorter list that look for their window together
_GOOD, _TOXIC = "good", "toxic"
_SIZES = ("removed", "redundant", "good_lost", "toxic_lost")


def text_conditions(text: Column) -> dict[str, Column]:
    """When a text fails each of the filters A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def flag_failures(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """A narrow, written row per document: id, row, part, a flag per filter, good, toxic.

    A NULL text counts as empty, a NULL part as the empty string. Texts are the same if
    their SHA-256 is; a document whose text a smaller id has fails ``REPEATED``. A row
    with a NULL id has no smaller one and no label. Of several labels of an id one that
    says good, or toxic, is enough. No text is shuffled.
    """
    bodies = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        whole_text(F.col(f"`{text}`")).alias("body"),
    )
    conditions = text_conditions(F.col("body"))
    read = cut(bodies.select(
        "id", F.monotonically_increasing_id().alias("row"), "part", F.unhex(F.sha2("body", 256)).alias("hash"),
        *[c.alias(name) for name, c in conditions.items()],
    ))
    firsts = read.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = splittable_join(read, firsts, ["hash"], "left")
    judged = labels.select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias(_GOOD), (F.col("toxic") == 1).alias(_TOXIC)
    ).where("id IS NOT NULL").groupBy("id").agg(F.max(_GOOD).alias(_GOOD), F.max(_TOXIC).alias(_TOXIC))
    known = splittable_join(marked, judged, ["id"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = cut(known.select(
        "id", "row", "part", *conditions, flag(F.col("id") > F.col("first")).alias(REPEATED),
        flag(F.col(_GOOD)).alias(_GOOD), flag(F.col(_TOXIC)).alias(_TOXIC),
    ))
    remove_cuts(read)
    return rows


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each id of ``short`` stands, or would, in ``long``; both ascend."""
    found, at = np.empty(len(short), np.int64), 0
    for start in range(0, len(short), _RUN):
        run = short[start:start + _RUN]
        reach, step = at, 1
        while reach < len(long) and long[reach] < run[-1]:
            reach += step
            step *= 2
        found[start:start + len(run)] = at + np.searchsorted(long[at:reach + 1], run)
        at = int(found[start + len(run) - 1])
    return found


def among(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each id, whether it is one of ``others``."""
    if not len(ids) or not len(others) or ids[-1] < others[0] or others[-1] < ids[0]:
        return np.zeros(len(ids), bool)
    if len(ids) <= len(others):
        at = gallop(ids, others)
        return (at < len(others)) & (others[np.minimum(at, len(others) - 1)] == ids)
    at = gallop(others, ids)
    held = np.zeros(len(ids), bool)
    there = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == others)
    held[at[there]] = True
    return held


def merged(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The union of a list with ids of which it has none."""
    short, long = (ids, new) if len(ids) < len(new) else (new, ids)
    return np.insert(long, gallop(short, long), short)


def interactions(lists: Mapping[str, np.ndarray], good: np.ndarray, toxic: np.ndarray) -> dict[tuple[str, str], list[int]]:
    """By (filters before, filter): ids removed, redundant, good and toxic ones of those removed.

    Each union of filters is made once, from that of one filter fewer.
    """
    names = sorted(lists)
    unions, out = {"": np.empty(0, np.int64)}, {}
    for size in range(len(names)):
        for chosen in combinations(names, size):
            before = "".join(chosen)
            for name in names:
                if name in chosen:
                    continue
                removed = lists[name][~among(lists[name], unions[before])]
                out[before, name] = [
                    len(removed), len(lists[name]) - len(removed), int(among(removed, good).sum()), int(among(removed, toxic).sum())
                ]
                grown = "".join(sorted(before + name))
                if grown not in unions:
                    unions[grown] = merged(unions[before], removed)
    return out


def posting_lists(rows: DataFrame, filters: list[str]) -> DataFrame:
    """(part, a sorted list per filter, good, toxic) of each part and range of ids.

    Ranges are the batches of rows ordered by part and id, so a part of any size is in
    as many ranges as it needs. The lists hold the rows' numbers in that order, which
    stand for their ids and differ also where ids repeat.
    """
    names = [*filters, _GOOD, _TOXIC]
    failing = rows.where(" OR ".join(f"`{name}`" for name in filters))
    ordered = failing.repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row").select("part", *names)
    schema = T.StructType([T.StructField("part", T.StringType()), *[T.StructField(n, T.ArrayType(T.LongType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            ends = pc.run_end_encode(batch.column(0))
            parts, stops = ends.values.to_pylist(), ends.run_ends.to_numpy()
            flags = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            lists = [[] for _ in names]
            for start, stop in zip([0, *stops[:-1]], stops):
                for of, flag in zip(lists, flags):
                    of.append(done + start + np.flatnonzero(flag[start:stop]))
            done += batch.num_rows
            columns = [pa.array(parts, pa.string()), *[pa.array(of, pa.list_(pa.int64())) for of in lists]]
            yield pa.RecordBatch.from_arrays(columns, ["part", *names])

    return ordered.mapInArrow(run, schema)


def sum_interactions(lists: DataFrame, filters: list[str]) -> DataFrame:
    """(part, before, filter, sizes): the sizes of all ranges of a part added up."""
    schema = "part string, before string, filter string, " + ", ".join(f"{n} bigint" for n in _SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str], np.ndarray] = {}
            for at, part in enumerate(batch.column("part").to_pylist()):
                ids = {n: batch.column(n)[at].values.to_numpy() for n in [*filters, _GOOD, _TOXIC]}
                for (before, name), sizes in interactions({f: ids[f] for f in filters}, ids[_GOOD], ids[_TOXIC]).items():
                    key = part, before, name
                    sums[key] = sums.get(key, 0) + np.array(sizes)
            keys = list(zip(*sums)) or [(), (), ()]
            sizes = np.array(list(sums.values())).reshape(len(sums), len(_SIZES)).T
            columns = [pa.array(k, pa.string()) for k in keys] + [pa.array(s, pa.int64()) for s in sizes]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "filter", *_SIZES])

    counted = lists.mapInArrow(run, schema)
    return counted.groupBy("part", "before", "filter").agg(*[F.sum(n).alias(n) for n in _SIZES])


def audit(rows: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter does there.

    ``rows`` are as ``flag_failures`` gives them: written, with a flag per filter of one
    letter. ``kept`` and ``removed`` count the part's documents after and at the step,
    ``redundant`` those that fail the filter and went earlier, ``unique_fails`` those
    that fail no other filter, ``good_lost`` and ``toxic_lost`` those of ``removed`` that
    are good or toxic, and ``shapley`` adds the filter's ``removed`` up over all orders.
    Every part has all rows, zeros included; without documents there are none.
    """
    filters = filters or ["A", "B", "C", "D", REPEATED]
    counts = sum_interactions(posting_lists(rows, filters), filters)
    orders = ["".join(order) for order in permutations(sorted(filters))]  # five filters: 120
    steps = (
        rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        .select("part", "n", F.explode(F.lit(orders)).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
        .withColumn("filter", F.expr("substr(filter_order, step, 1)"))
        .withColumn("before", F.expr("array_join(array_sort(split(substr(filter_order, 1, step - 1), '')), '')"))
    )
    sized = steps.join(counts, ["part", "before", "filter"], "left").fillna(0, list(_SIZES))
    so_far = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    of_filter = W.partitionBy("part", "filter")
    return sized.select(
        "part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"),
        "removed", "redundant",
        F.max(F.when(F.col("step") == len(filters), F.col("removed"))).over(of_filter).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(of_filter).alias("shapley"),
    )
