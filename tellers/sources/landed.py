"""Feed pages landed as JSON lines, one page envelope per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.operators.sizing import splittable_join

ARRIVAL = "arrival"
_DAMAGED = "_damaged"


def envelope(record: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("odata.count", T.StringType()),
        T.StructField("value", T.ArrayType(record)),
        T.StructField(_DAMAGED, T.StringType()),
    ])


def parse_pages(pages: DataFrame, record: T.StructType, column: str = "value") -> DataFrame:
    """``pages`` with ``declared`` record count, ``records``, and ``whole``.

    A page is whole if all of it parses, each field as the type it should have.
    """
    parsed = F.from_json(column, envelope(record), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED})
    return pages.select("*", parsed.alias("_page")).select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.expr("try_cast(_page.`odata.count` AS BIGINT)").alias("declared"),
        F.col("_page.value").alias("records"),
        (F.col(f"_page.{_DAMAGED}").isNull() & F.col("_page.value").isNotNull()).alias("whole"),
    )


def explode_pages(
    pages: DataFrame, record: T.StructType, column: str = "value", arrival: Column | None = None
) -> DataFrame:
    """One row per record of the whole pages; an empty page gives none.

    With ``arrival``, what orders the pages, a column of that name holds it and the
    record's place in its page.
    """
    return records_of(parse_pages(pages, record, column), arrival)


def records_of(parsed: DataFrame, arrival: Column | None = None) -> DataFrame:
    """The same from parsed pages."""
    whole = parsed.where("whole")
    if arrival is None:
        return whole.select(F.inline("records"))
    placed = whole.select(arrival.alias("_page_arrival"), F.posexplode("records").alias("_place", "_record"))
    return placed.select("_record.*", F.struct("_page_arrival", "_place").alias(ARRIVAL))


def rejected_pages(pages: DataFrame, record: T.StructType, column: str = "value") -> DataFrame:
    """The pages that are not whole, as they came."""
    return parse_pages(pages, record, column).where("NOT whole").select(*[F.col(f"`{c}`") for c in pages.columns])


def completeness(pages: DataFrame, record: T.StructType, column: str = "value", key: str = "id") -> DataFrame:
    """Pages, damaged pages and distinct records against the feed's own count."""
    return completeness_of(parse_pages(pages, record, column), key)


def completeness_of(parsed: DataFrame, key: str = "id") -> DataFrame:
    """The same from parsed pages."""
    parsed = parsed.select(
        "declared", "whole", F.when(F.col("whole"), F.transform("records", lambda r: r[key])).alias("ids")
    )
    seen = parsed.select(F.explode("ids").alias("id")).agg(F.count_distinct("id").alias("records"))
    counted = parsed.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("whole")).alias("damaged"),
        F.coalesce(F.max("declared"), F.lit(0)).alias("declared"),
    )
    return counted.withColumn("records", seen.scalar()).select(
        "pages", "damaged", "records", "declared",
        ((F.col("damaged") == 0) & (F.col("records") >= F.col("declared"))).alias("complete"),
    )


def _file_of_line() -> Column:
    return F.struct(
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def with_line(lines: DataFrame) -> DataFrame:
    """(value, page_arrival) of lines that have their ``file``; lines of a block are numbered as read."""
    arrival = F.struct("file.modified", "file.file", "file.block", F.monotonically_increasing_id().alias("line"))
    return lines.select("value", arrival.alias("page_arrival"))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(value, page_arrival) of the lines under ``path``; later files and lines are greater."""
    return with_line(spark.read.text(path).select("value", _file_of_line().alias("file")))


def landed_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(value, file) of the lines under ``path`` as a stream that picks up new files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", _file_of_line().alias("file"))


def read_pages(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """The records of all whole pages landed under ``path``, with their ``arrival``."""
    return explode_pages(landed_pages(spark, path), record, arrival=F.col("page_arrival"))


def stream_pages(
    spark: SparkSession, path: str, record: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """The same as a stream that picks up newly landed files, without the arrival.

    A damaged page ends the stream, so none is lost unseen; ``streaming.pages.land``
    sets damaged pages aside and goes on.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    parsed = parse_pages(lines, record)
    damaged = F.raise_error(F.concat(F.lit("damaged page: "), F.substring("value", 1, 200))).cast(parsed.schema["records"].dataType)
    return parsed.select(F.when(F.col("whole"), F.col("records")).otherwise(damaged).alias("records")).select(F.inline("records"))


def restrict_to_ids(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Records whose ``key`` is among ``ids``, a one-column DataFrame with repeats.

    Ids are made distinct first, on the map side, so that one that most rows name
    is a single row in the join.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    chosen = splittable_join(records, wanted, [key], "left_semi")
    return chosen.select(*records.columns)
