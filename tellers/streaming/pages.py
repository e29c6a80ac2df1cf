"""Landed pages as a restartable stream: records, damaged pages and counts, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tellers.operators.bitmaps import count_ids, id_bitmaps
from tellers.schema import ARRIVAL_TYPE
from tellers.session import cut, remove_cuts
from tellers.sources.landed import ARRIVAL, landed_lines, parse_pages, records_of, with_line

_COUNTS = "pages bigint, damaged bigint, declared bigint"
_BITMAPS = "bucket bigint, bitmap binary"


def land(
    spark: SparkSession, path: str, record: T.StructType, out: str, checkpoint: str, *, key: str = "id",
    files_per_trigger: int = 1000, available_now: bool = True,
) -> StreamingQuery:
    """Take in the pages that land under ``path``, each once, and lose none.

    A micro-batch is parsed once and leaves four folders under ``out``: the records of
    its whole pages with their arrival, the damaged pages as they came, its counts, and
    bitmaps of the record keys seen. They are named after the batch and overwritten, so
    a batch that runs again after a failure counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_pages(with_line(batch), record)
        pages = cut(parsed.withColumn("value", F.expr("IF(whole, NULL, value)")))
        records = records_of(pages, F.col("page_arrival"))
        counts = pages.agg(
            F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("whole")).alias("damaged"), F.max("declared").alias("declared")
        )
        made = {
            "records": records, "rejected": pages.where("NOT whole").select(F.col("value").alias("page")),
            "counts": counts, "seen": id_bitmaps(records, key),
        }
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        remove_cuts(pages)

    lines = landed_lines(spark, path, files_per_trigger)
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def rejected_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(page): the damaged pages of all batches."""
    return spark.read.schema("page string, batch bigint").parquet(f"{out}/rejected").select("page")


def completeness_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Pages, damaged pages and distinct records of all batches against the feed's own count.

    Counts add up and sets of keys merge, so no record is read again.
    """
    counts = spark.read.schema(_COUNTS + ", batch bigint").parquet(f"{out}/counts").agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("damaged"), F.lit(0)).alias("damaged"),
        F.coalesce(F.max("declared"), F.lit(0)).alias("declared"),
    )
    seen = count_ids(spark.read.schema(_BITMAPS + ", batch bigint").parquet(f"{out}/seen"))
    return counts.withColumn("records", seen.scalar()).select(
        "pages", "damaged", "records", "declared",
        ((F.col("damaged") == 0) & (F.col("records") >= F.col("declared"))).alias("complete"),
    )


def record_stream(spark: SparkSession, out: str, record: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """The landed records with their ``arrival``, as a stream of what ``land`` has written.

    A file that a repeated batch has replaced is passed over; its records are in the
    file that replaced it.
    """
    schema = T.StructType([*record.fields, T.StructField(ARRIVAL, ARRIVAL_TYPE)])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").parquet(f"{out}/records")
