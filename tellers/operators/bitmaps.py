"""Sets of whole-number ids as bitmaps: 32,768 consecutive ids in 4 KB.

An exact set that merges: bitmaps of a range are combined by OR, so what batches have
seen adds up without reading them again. Ids that are far apart take a bitmap each; the
feed numbers its records one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.sizing import splittable_join


def id_bitmaps(df: DataFrame, column: str = "id") -> DataFrame:
    """(bucket, bitmap) of the ids of a column; NULL is no id.

    A task's ids are combined before they are shuffled, so a bucket that most rows fall
    into is one row of a task.
    """
    ids = df.select(F.col(column).cast("long").alias("id")).where("id IS NOT NULL")
    placed = ids.select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One bitmap per bucket."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_ids(bitmaps: DataFrame) -> DataFrame:
    """(ids): how many ids the sets have together."""
    counted = merged_bitmaps(bitmaps).select(F.bitmap_count("bitmap").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("ids"))


def ids_among(ids: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The distinct ids, a one-column DataFrame, that are in the set."""
    name = ids.columns[0]
    asked = ids.where(F.col(name).isNotNull()).distinct().select(
        name, F.bitmap_bucket_number(F.col(name)).alias("bucket"), F.bitmap_bit_position(F.col(name)).alias("at")
    )
    held = splittable_join(asked, merged_bitmaps(bitmaps), ["bucket"], "inner")
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(at div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return held.withColumn("byte", byte).where("shiftright(byte, CAST(at % 8 AS INT)) & 1 = 1").select(name)
