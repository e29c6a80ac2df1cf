"""Consecutive numbers in key order, in as many tasks as the rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellers.session import cut

ROWS_PER_BUCKET = 200_000
LEAST_BUCKETS = 8


def number_rows(
    df: DataFrame, key: str, name: str = "n", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in the order of the unique ``key``.

    ``df`` is computed once, into a table, whose rows are counted and dealt to
    buckets of key ranges; the number of buckets follows the rows. The buckets' row
    counts, a number each, give them their offsets, and the rank of a row is a window
    over its bucket.
    """
    rows = cut(df)
    buckets = max(LEAST_BUCKETS, -(-rows.count() // rows_per_bucket))
    placed = cut(rows.repartitionByRange(buckets, key).withColumn("_bucket", F.spark_partition_id()))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    running = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_offset")
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return (
        placed.withColumn("_rank", rank)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )
