"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Rows are dealt to buckets by the length of their vectors. A bucket keeps, for each
coordinate, its rows sorted by that coordinate of their direction. A score of at least t
needs a direction within some angle of the anchor's, so on the anchor's largest
coordinates, its focus, the row's value lies in a known range; the rows in all ranges are
the candidates and are scored exactly. Buckets whose longest row cannot reach t take no
part, and where the ranges rule little out the whole bucket is scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.session import cut, remove_cuts

LEAST_BUCKETS = 48
NUMBERS_PER_BUCKET = 1 << 22  # components of a bucket's rows, about
ANCHORS_PER_BLOCK = 8192
FOCUS = 4
DENSE = 0.25  # of a bucket's rows; from this share of candidates on all are scored
_STRIP = 1 << 21  # scores at once
_EXACT = float(1 << 53)
_LEAST, _MOST = -(2**63), 2**63 - 1
_SLACK = 1e-7

_PACKED = "id bigint, label string, anchor boolean, length double, narrow binary, wide binary"
_FOUND = "anchor bigint, band int, id bigint, score bigint"


def pack(rows: DataFrame, key: str, label: str, vector: str, anchors: Column, scale: float) -> DataFrame:
    """Rows as numbers: each component x becomes floor(scale * x), four or eight bytes long.

    A row with a NULL key, label or vector, or with a component that is NULL or not
    finite, before or after scaling, takes no part.
    """
    numbers = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").cast("array<double>").alias("x"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    usable = numbers.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                vectors = [np.floor(scale * np.asarray(x.values)) for x in batch.column(3)]
            vectors = [v if np.isfinite(v).all() else None for v in vectors]
            peaks = [np.abs(v).max(initial=0) if v is not None else 0 for v in vectors]
            lengths = [p * np.sqrt(((v / p) ** 2).sum()) if p else 0.0 for v, p in zip(vectors, peaks)]
            fits = [v is not None and p < 2**31 for v, p in zip(vectors, peaks)]
            columns = [
                *batch.columns[:3], pa.array(lengths, pa.float64()),
                pa.array([v.astype(np.int32).tobytes() if f else None for v, f in zip(vectors, fits)], pa.binary()),
                pa.array([v.tobytes() if not f and v is not None else None for v, f in zip(vectors, fits)], pa.binary()),
            ]
            names = ["id", "label", "anchor", "length", "narrow", "wide"]
            kept = pa.array([v is not None for v in vectors], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return usable.mapInArrow(run, _PACKED)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """A table's vectors as rows of one width; a shorter one ends in zeros."""
    out = np.zeros((table.num_rows, width))
    for row, narrow, wide in zip(out, table["narrow"], table["wide"]):
        v = np.frombuffer(narrow.as_buffer(), np.int32) if narrow.is_valid else np.frombuffer(wide.as_buffer(), np.float64)
        row[:len(v)] = v
    return out


def _width(table: pa.Table) -> int:
    sizes = [len(b.as_buffer()) // n for name, n in (("narrow", 4), ("wide", 8)) for b in table[name] if b.is_valid]
    return max(sizes, default=0)


def _best(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by the smaller id."""
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], ~scores[near]))][:count]  # ~ turns the order round for every number


class Bucket:
    """Rows of about one length, with the sorted coordinate lists that anchors ask for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        with np.errstate(over="ignore", invalid="ignore"):
            peak = np.abs(vectors).max(axis=1, initial=0)
            self.lengths = peak * np.sqrt(((vectors / np.where(peak, peak, 1)[:, None]) ** 2).sum(axis=1))
        self.longest = self.lengths.max(initial=0)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of coordinate f in order, the rows they belong to, and each row's place."""
        if f not in self._lists:
            values = self.vectors[:, f] / np.where(self.lengths, self.lengths, 1)
            order = np.argsort(values, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self._lists[f] = values[order], order, place
        return self._lists[f]

    def candidates(self, direction: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that may be within the angle of ``cosine`` of the direction; None for all.

        The values that a coordinate may take are those from cos(a + b) to cos(a - b),
        where a is the direction's angle with the coordinate's axis and b the angle
        allowed.
        """
        if cosine <= 0:
            return None
        cosine = min(cosine, 1.0)
        focus = np.argpartition(-np.abs(direction), min(FOCUS, len(direction)) - 1)[:FOCUS]
        ranges = []
        for f in focus:
            q = float(np.clip(direction[f], -1, 1))
            spread = np.sqrt((1 - q * q) * (1 - cosine * cosine))
            low = -1.0 if q <= -cosine else q * cosine - spread
            high = 1.0 if q >= cosine else q * cosine + spread
            values, order, place = self._list(int(f))
            ranges.append((np.searchsorted(values, low - _SLACK), np.searchsorted(values, high + _SLACK, "right"), order, place))
        ranges.sort(key=lambda r: r[1] - r[0])
        first, last, order, _ = ranges[0]
        if last - first >= DENSE * len(self.ids):
            return None
        found = order[first:last]
        for first, last, _, place in ranges[1:]:
            at = place[found]
            found = found[(at >= first) & (at < last)]
        return found

    def scores(self, vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond BIGINT the bound stands in."""
        if self.longest * np.sqrt((vector**2).sum()) < _EXACT:
            return (self.vectors[rows] @ vector).astype(np.int64)
        numbers = [int(x) for x in vector]
        sums = [sum(int(a) * b for a, b in zip(row, numbers)) for row in self.vectors[rows]]
        return np.array([min(max(s, _LEAST), _MOST) for s in sums], dtype=np.int64)


def search_bucket(
    bucket: Bucket, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bands: list[list[tuple[int, int, int]]],
    count: int, same: bool,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor's place, band, row ids, scores) of the best rows of each band of each anchor.

    A band is (name, least score, greatest score). ``same`` asks for rows of the anchor's
    label but of another id, otherwise for rows of another label.
    """
    lengths = np.sqrt((vectors**2).sum(axis=1))
    whole = []

    def chosen(i: int, rows: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        equal = bucket.labels[rows] == labels[i]
        fit = equal & (bucket.ids[rows] != ids[i]) if same else ~equal
        for name, low, high in bands[i]:
            inside = np.flatnonzero(fit & (scores >= low) & (scores <= high))
            if len(inside):
                at = inside[_best(bucket.ids[rows[inside]], scores[inside], count)]
                yield i, name, bucket.ids[rows[at]], scores[at]

    for i, of in enumerate(bands):
        if not of:
            continue
        least, reach = float(min(low for _, low, _ in of)), lengths[i] * bucket.longest
        if least > reach * (1 + _SLACK):
            continue
        rows = bucket.candidates(vectors[i] / lengths[i], least / reach - _SLACK) if least > 0 and reach > 0 else None
        if rows is None:
            whole.append(i)
        elif len(rows):
            yield from chosen(i, rows, bucket.scores(vectors[i], rows))
    every = np.arange(len(bucket.ids))
    strip = max(1, _STRIP // max(len(every), 1))
    for start in range(0, len(whole), strip):
        some = whole[start:start + strip]
        if bucket.longest * lengths[some].max() < _EXACT:
            scored = (vectors[some] @ bucket.vectors.T).astype(np.int64)
        else:
            scored = [bucket.scores(vectors[i], every) for i in some]
        for i, scores in zip(some, scored):
            yield from chosen(i, every, scores)


def _compare(count: int, same: bool):
    """A function of one bucket's rows and one block of anchors."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        width = max(_width(rows), _width(anchors))
        out: list[list] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            bucket = Bucket(rows["id"].to_numpy(), np.array(rows["label"].to_pylist(), object), _matrix(rows, width))
            numbers, bands = anchors["anchor"].to_numpy(), anchors["bands"].to_pylist()
            of = [[(b["band"], b["low"], b["high"]) for b in bands_of] for bands_of in bands]
            labels = np.array(anchors["label"].to_pylist(), object)
            for i, band, ids, scores in search_bucket(bucket, anchors["id"].to_numpy(), labels, _matrix(anchors, width), of, count, same):
                for column, values in zip(out, (np.full(len(ids), numbers[i]), np.full(len(ids), band), ids, scores)):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "band", "id", "score"])

    return run


def _best_of(found: DataFrame, count: int) -> DataFrame:
    """The best rows of all buckets, ``rank`` from 1."""
    order = W.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(rows: DataFrame, anchors: DataFrame, buckets: int, blocks: int, count: int, same: bool) -> DataFrame:
    """(anchor, band, id, score, rank): the ``count`` best rows of each band of each anchor.

    ``rows`` have a ``bucket``; ``anchors`` a number, a ``block`` and their ``bands``. Each
    anchor first meets one bucket. If that has enough rows for a band, the least score of
    them is a bound that every better row reaches, and the search of all buckets starts
    from it.
    """
    numbered = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    first = rows.withColumn("block", F.lit(0)).groupBy("bucket", "block").cogroup(
        anchors.withColumn("block", F.lit(0)).withColumn("bucket", numbered).groupBy("bucket", "block")
    ).applyInArrow(_compare(count, same), _FOUND)
    bounds = first.groupBy("anchor", "band").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
    listed = bounds.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("band", "bound"))).alias("bounds"))
    raised = anchors.join(listed, "anchor", "left").withColumn("bands", F.transform("bands", lambda b: F.struct(
        b["band"].alias("band"), F.greatest(b["low"], F.coalesce(F.col("bounds")[b["band"]], b["low"])).alias("low"), b["high"].alias("high"),
    ))).drop("bounds")
    longest = rows.groupBy("bucket").agg(F.max("length").alias("longest"))
    least = F.array_min(F.transform("bands", lambda b: b["low"]))
    dealt = raised.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(longest, "bucket")
    dealt = dealt.where(least <= F.col("length") * F.col("longest") * (1 + _SLACK)).drop("longest")
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = copies.groupBy("bucket", "block").cogroup(dealt.groupBy("bucket", "block")).applyInArrow(_compare(count, same), _FOUND)
    return _best_of(found, count)


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a score that is not negative, rounded to a whole number."""
    hundreds, rest = F.expr("score div 100"), score % 100
    return hundreds * percent + ((rest * percent + (99 if up else 0)) / 100).cast("long")


def mine(
    rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    numbers_per_bucket: int = NUMBERS_PER_BUCKET, anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """Per anchor and positive, the best negatives that score ``low`` to ``high`` % of the positive.

    A score is the inner product of the scaled vectors, as whole numbers. ``anchors`` says
    which rows are anchors; equal rows (id, label and vector) are one anchor. Positives
    are the best rows of the anchor's label and of another id, negatives the best of
    other labels; ties go to the smaller id, and rows that repeat an id count one by one.
    A vector shorter than another ends in zeros; without a component its scores are zero.
    A positive with a negative score has no negatives, nor has one whose bounds no row
    meets. No rows, or no anchors, give no rows. Extra columns are not read.

    Every row is in one bucket and every anchor in one block; the pairs of both are
    groups of bounded size. Scores beyond 53 bits are computed one by one.
    """
    packed = cut(pack(rows, key, label, vector, anchors, scale))
    size = packed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"),
        F.coalesce(F.max(F.greatest(F.octet_length("narrow") / 4, F.octet_length("wide") / 8)), F.lit(1)).alias("width"),
    ).first()
    buckets = max(LEAST_BUCKETS, -(-size["rows"] * max(int(size["width"]), 1) // numbers_per_bucket))
    blocks = max(1, -(-size["anchors"] // anchors_per_block))
    dealt = packed.drop("anchor").repartitionByRange(buckets, "length", "id")
    bucketed = cut(dealt.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(buckets))))
    chosen = packed.where("anchor").drop("anchor").distinct().withColumn("anchor", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    kept = cut(chosen.withColumn("block", block))
    remove_cuts(packed)
    any_score = F.array(F.struct(F.lit(0).alias("band"), F.lit(_LEAST).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high")))
    best = cut(search(bucketed, kept.withColumn("bands", any_score), buckets, blocks, positives, True))
    score = F.col("score")
    band = F.struct(F.col("rank").alias("band"), _share(score, low, True).alias("low"), _share(score, high, False).alias("high"))
    bands = best.where("score >= 0").select("anchor", band.alias("b")).where("b.low <= b.high")
    listed = bands.groupBy("anchor").agg(F.array_sort(F.collect_list("b")).alias("bands"))  # one a positive at most
    wanted = cut(kept.join(listed, "anchor"))
    found = search(bucketed, wanted, buckets, blocks, negatives, False)
    positive = best.select("anchor", F.col("rank").alias("band"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    named = found.join(positive, ["anchor", "band"]).join(kept.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
