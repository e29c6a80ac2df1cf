"""Votes as a restartable stream into an append log, and the log folded into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tellers.operators.keyed import latest
from tellers.schema import ARRIVAL_TYPE, TABLES
from tellers.sources.landed import ARRIVAL
from tellers.sources.store import Store

_TIE = ["ballot_id", "member_id", "vote_type_id"]
_FOLDED = "folded_batch"
STATE_FOR = "1 hour"


def latest_of_ids(votes: DataFrame, state_for: str = STATE_FOR) -> DataFrame:
    """A stream of votes with their arrival, reduced to the last that arrived of each id.

    The state is one vote for each id and window of processing time; a batch gives the
    ids that it has votes of, with the last of the window. The batch's own time is the
    event time, so no vote is ever late, and the watermark lets the state of past windows
    go. What an id had in an earlier window is compared where the votes are read or
    folded.
    """
    timed = votes.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", state_for)
    whole = F.struct(*[F.col(c) for c in votes.columns])
    order = F.struct(ARRIVAL, *_TIE)
    newest = timed.groupBy(F.window("_seen", state_for).alias("_window"), "id").agg(F.max_by(whole, order).alias("_vote"))
    return newest.select("_vote.*")


def stream_votes(
    votes: DataFrame, log: str, checkpoint: str, *, available_now: bool = True, state_for: str = STATE_FOR
) -> StreamingQuery:
    """Write a stream of votes to ``log``, one folder per micro-batch.

    Votes with an ``arrival`` pass a state keyed by id that holds the last to arrive;
    without one, a micro-batch is reduced to the greatest row per id. A batch's folder is
    named after it and overwritten, so a batch that runs again after a failure leaves
    one copy; the cost of a batch does not grow with what is stored.
    """
    arrives = ARRIVAL in votes.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        reduced = batch if arrives else latest(batch, ["id"], _TIE)
        reduced.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    source = latest_of_ids(votes, state_for) if arrives else votes
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if arrives:
        writer = writer.outputMode("update")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _logged(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name != ARRIVAL]
    more = [T.StructField(ARRIVAL, ARRIVAL_TYPE), T.StructField("batch", T.LongType())]
    return spark.read.schema(T.StructType([*fields, *more])).parquet(log)


def read_log(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The log's current votes: of an id that came in several batches the last to arrive.

    Votes without an arrival go by batch, and in it by value. This ranks the whole log;
    ``fold_log`` reads each batch once.
    """
    rows = latest(_logged(spark, log, schema), ["id"], [ARRIVAL, "batch", *_TIE])
    return rows.select(*[F.col(n) for n in schema.names])


def fold_log(store: Store, log: str) -> int:
    """Take the log's new batches into the table ``streamed_vote``; how many partitions that wrote.

    The table has the last to arrive of each id, and a batch reads and writes only the
    partitions its ids are in. Folding a batch again changes nothing. Batches up to the
    last folded one are not read any more.
    """
    done = int(store.progress(f"{_FOLDED}:{log}") or -1)
    by_batch = F.struct(
        F.struct(F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("file"),
                 F.lit(None).cast("long").alias("block"), F.col("batch").alias("line")).alias("_page_arrival"),
        F.lit(None).cast("int").alias("_place"),
    )  # for votes that came without an arrival
    logged = _logged(store.spark, log, TABLES["streamed_vote"]).where(F.col("batch") > done)
    new = logged.withColumn(ARRIVAL, F.coalesce(ARRIVAL, by_batch))
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    written = store.upsert("streamed_vote", new.where(F.col("batch") <= last), [ARRIVAL, *_TIE], newest=True)
    store.set_progress(**{f"{_FOLDED}:{log}": last})
    return written
