"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.llm.text import text_hash
from tellers.session import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20
ROWS_PER_BUCKET = 4_000
LEAST_BUCKETS = 256
WEIGHT_CLASSES = 256  # different weights that the distribution of keys tells apart
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}  # of a labelled document; one without a label weighs 1


def quality_weights(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(key, weight) of the labelled documents; of repeated labels the best one counts."""
    best = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("label_key")).agg(
        F.max(f"`{quality}`").alias("label")
    )
    weight = F.lit(1.0)
    for value, by in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("label") == value, F.lit(by)).otherwise(weight)
    return best.select("label_key", weight.alias("label_weight"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source.

    The sources in order of code points, NULL last, weigh ``weights`` in turn and
    share the sum of all sizes. Filling runs from the source that reaches its limit
    of ``max_epochs`` sizes first: with the k first at their limits, the rest divide
    what is left by weight. That level rises while limits are reached and falls
    afterwards, so the highest one is the answer.
    """
    cyclic = F.array(*map(F.lit, weights))
    ordered = sizes.select(
        "source", "source_size",
        F.element_at(cyclic, (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("long").alias("weight"),
    )
    before = W.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ordered.withColumn("level", level)
    return levels.select(
        "source", "source_size",
        F.least((max_epochs * F.col("source_size")).cast("double"), F.max("level").over(whole) * F.col("weight")).alias("target"),
    )


def sampling_key(identity: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential variate of rate ``weight``, the same on every run."""
    draw = text_hash(F.concat_ws("/", F.lit(str(seed)), identity.cast("string")))
    return -F.log((draw.cast("double") + 1) / F.lit(float(2**60 + 2))) / weight


def weight_shares(docs: DataFrame, rate: Column) -> list[tuple[float, int]]:
    """(weight, rows) of the weights that occur, those within a few percent as one.

    Weights are classes of a logarithmic scale, finer than a tenth where ``WEIGHT_CLASSES``
    allow it: a table with more classes is counted again on a coarser scale.
    """
    step = 1 / 8
    while True:
        level = F.round(F.least(F.greatest(F.log2(rate), F.lit(-1000.0)), F.lit(1000.0)) / step)
        counted = docs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("level").limit(WEIGHT_CLASSES + 1).collect()
        if len(counted) <= WEIGHT_CLASSES:
            return [(2.0 ** (r["level"] * step), r["n"]) for r in counted]
        step *= 2


def share_below(key: Column, shares: list[tuple[float, int]]) -> Column:
    """The share of rows whose sampling key is expected below ``key``, less than one."""
    total = sum(n for _, n in shares)
    above = sum((F.exp(-key * w) * (n / total) for w, n in shares), F.lit(0.0))
    return F.greatest(F.least(1 - above, F.lit(1 - 2.0**-52)), F.lit(0.0))


def mix_sources(
    docs: DataFrame, size: str = "size", weight: str = "weight", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``taken``, the words taken of each row.

    Each source's target is first met by complete epochs, every row in full. What is
    left goes to rows in the order of their exponential keys, whose rate is the
    row's quality weight, so that better documents tend to come first; the row at
    the end of the budget gives its first words only. So a source gives its target
    rounded to whole words, and no row more than ``max_epochs`` times its size.

    The prefix sums run in two steps, since one source may hold most rows: the
    distribution function of the keys of all rows, a mixture over their weights, cuts a
    source into buckets of some thousand rows, sums of buckets give each bucket its
    offset, and a window runs inside a bucket.

    ``size`` and ``weight`` are columns of ``docs``; a NULL size counts as 0 and a
    NULL or non-positive weight as 1. NULL sources are one source, the last. Equal
    keys are taken in order of ``key`` and size; a row with a NULL key has the
    sampling key of the text "null". Rows that repeat are rows of their own. All
    other columns stay, but for columns named as the results, which are replaced.
    """
    out = ("source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in out]
    amount = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long")
    rate = F.when(F.col(f"`{weight}`") > 0, F.col(f"`{weight}`").cast("double")).otherwise(F.lit(1.0))
    shares = weight_shares(docs, rate)
    buckets = max(LEAST_BUCKETS, sum(n for _, n in shares) // ROWS_PER_BUCKET)
    identity = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    # a NULL source has a name of its own, which no other has
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("~"))
    drawn = docs.select(
        *[f"`{c}`" for c in kept],
        named.alias("_mix_source"), amount.alias("_mix_size"), sampling_key(identity, rate, seed).alias("_mix_key"),
    ).withColumn("_mix_bucket", F.floor(share_below(F.col("_mix_key"), shares) * buckets))

    sums = cut(drawn.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum")))
    sizes = sums.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("source_size")).select(
        F.when(F.col("_mix_source") != "~", F.expr("substr(_mix_source, 2)")).alias("source"), "source_size"
    )
    targets = source_targets(sizes, weights, max_epochs).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("_mix_source"), "source_size", "target"
    )
    earlier = W.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = (
        sums.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0)))
        .join(targets, "_mix_source")
        .withColumn("_mix_epochs", epochs)
        .withColumn("_mix_budget", F.round(F.col("target") - F.col("_mix_epochs") * F.col("source_size")).cast("long"))
    )
    group = ["_mix_source", "_mix_bucket"]
    before_row = W.partitionBy(*group).orderBy("_mix_key", F.asc_nulls_last(f"`{key}`"), "_mix_size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_mix_budget") - F.col("_mix_before") - F.coalesce(F.sum("_mix_size").over(before_row), F.lit(0))
    part = F.least(F.col("_mix_size"), F.greatest(left, F.lit(0)))
    return drawn.join(plan, group).select(
        *[f"`{c}`" for c in kept], "source_size", "target",
        (F.col("_mix_epochs") * F.col("_mix_size") + part).cast("long").alias("taken"),
    )
