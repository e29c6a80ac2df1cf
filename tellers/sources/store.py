"""Tables as partitioned Parquet folders, and the progress of the jobs that fill them.

Spark's own writers hold the tables. Rows of a table with an id are partitioned by
ranges of it, rows of a fact by the append they came with, so that a write replaces whole
partitions and no others. A change is written beside the tables first and noted; then
its partitions are put in place by a partition overwrite, which gives the same when it
runs again. What a stop left half done is finished before anything else is written, or
when the store is next opened. A
store has one writer at a time; readers should not be under way while it writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tellers.operators.keyed import latest, without_keys
from tellers.schema import TABLES
from tellers.session import cut, local_rows, remove_cuts, remove_folder

_PROGRESS = T.StructType().add("value", "string").add("written", "string").add("key", "string")
PART = "_part"
_PENDING = "pending"

# Sort order inside the files, for min/max skipping. The second column also
# splits a hot first one over several files.
LAYOUT: dict[str, tuple[str, ...]] = {
    "vote": ("ballot_id", "member_id"),
    "rejected_vote": ("ballot_id", "member_id"),
    "bill_topic": ("bill_id", "topic_id"),
    "ballot": ("held_at", "id"),
    "bill": ("id",),
    "member": ("id",),
    "bill_gram": ("gram", "field", "range"),
    "member_bill_votes": ("bill_id", "member_id"),
    "member_topic_votes": ("member_id", "topic_id"),
}

# Tables whose rows have an id of their own, and the ids of one partition.
RANGES: dict[str, tuple[str, int]] = {
    "ballot_type": ("id", 1_000_000),
    "vote_type": ("id", 1_000_000),
    "party": ("id", 1_000_000),
    "member": ("id", 1_000_000),
    "bill": ("id", 1_000_000),
    "topic": ("id", 1_000_000),
    "ballot": ("id", 1_000_000),
    "streamed_vote": ("id", 10_000_000),
    "loaded_ballot": ("bucket", 1_000),
}

# Columns that are looked up by value against the sort order. Bloom filters say which
# row groups, made smaller for it, may hold a value.
LOOKUPS: dict[str, tuple[str, ...]] = {"vote": ("member_id",)}
ROW_GROUP_BYTES = 16 * 1024 * 1024


def current_state(ledger: DataFrame) -> DataFrame:
    """Ledger (key, value, seq): the last value written per key."""
    return latest(ledger, ["key"], ["seq"]).select("key", "value")


def partition_of(table: str, ranges: Mapping[str, tuple[str, int]] = RANGES) -> Column:
    """The partition of a row of a table with an id."""
    key, width = ranges[table]
    return F.coalesce(F.expr(f"CAST(`{key}` div {width} AS STRING)"), F.lit("none"))


@dataclass(frozen=True)
class Store:
    """Tables and progress under one root folder."""

    spark: SparkSession
    root: str

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """The store under ``root``, made if there is none; an unfinished change is finished.

        Only this makes one: elsewhere a root without progress is an error, so a
        wrong or unmounted folder does not pass for an empty store.
        """
        store = cls(spark, root)
        try:
            store.progress(_PENDING)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            store.set_progress(created="true")
        store.finish()
        return store

    # ---- progress

    def progress(self, key: str) -> str | None:
        """The last value set for ``key``."""
        noted = self.spark.read.schema(_PROGRESS).parquet(f"{self.root}/progress").where(F.col("key") == key)
        row = noted.orderBy(F.desc("written"), F.desc("value")).first()
        return row["value"] if row else None

    def set_progress(self, **values: object) -> None:
        """Set values, each the whole of its key's partition."""
        noted = [(key, str(value)) for key, value in values.items()]
        rows = local_rows(self.spark, noted, T.StructType().add("key", "string").add("value", "string"))
        dated = rows.select("value", F.current_timestamp().cast("string").alias("written"), "key").coalesce(1)
        _overwrite_partitions(dated, f"{self.root}/progress", "key")

    # ---- tables

    def read(self, table: str) -> DataFrame:
        """The current rows, or an empty table of the right shape."""
        return self._stored(table).drop(PART)

    def _stored(self, table: str) -> DataFrame:
        self.spark.read.schema(_PROGRESS).parquet(f"{self.root}/progress")  # a wrong root is an error
        shape = T.StructType([*TABLES[table].fields, T.StructField(PART, T.StringType())])
        try:
            return self.spark.read.schema(shape).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_rows(self.spark, [], shape)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Make ``df`` the whole of ``table`` and return it."""
        self.finish()
        part = partition_of(table) if table in RANGES else F.lit("all")
        self._put([self._stage(table, df, part, whole=True)])
        return self.read(table)

    def upsert(self, table: str, batch: DataFrame, order: Sequence[str], newest: bool = False) -> int:
        """Put rows in by id; returns how many partitions were written.

        Of several rows of an id the one with the greatest ``order`` counts; it replaces
        the stored row, with ``newest`` only where it has the greater ``order``. Only the
        partitions that the batch's ids name are read and written.
        """
        return self.change(upserts={table: (batch, order, newest)})

    def append(self, **frames: DataFrame) -> None:
        """Add rows to tables, all or none, without touching those stored."""
        self.change(appends=frames)

    def change(
        self, appends: Mapping[str, DataFrame] = {}, upserts: Mapping[str, tuple[DataFrame, Sequence[str], bool]] = {}
    ) -> int:
        """Several appends and upserts that take effect together; how many partitions upserts wrote."""
        self.finish()
        load, parts = uuid.uuid4().hex, 0
        staged = [self._stage(table, df, F.lit(load)) for table, df in appends.items()]
        for table, (batch, order, newest) in upserts.items():
            rows = cut(self._last_of_ids(table, batch, order))
            touched = [row[PART] for row in rows.select(PART).distinct().collect()]  # names of folders
            staged.append(self._stage(table, self._merged(table, rows, touched, order, newest), F.col(PART)))
            parts += len(touched)
            remove_cuts(rows)
        self._put(staged)
        return parts

    def _last_of_ids(self, table: str, batch: DataFrame, order: Sequence[str]) -> DataFrame:
        shaped = batch.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])
        return latest(shaped, [RANGES[table][0]], order).withColumn(PART, partition_of(table))

    def _merged(
        self, table: str, rows: DataFrame, touched: Sequence[str], order: Sequence[str], newest: bool
    ) -> DataFrame:
        """The rows of the touched partitions with a batch's rows put in."""
        key, _ = RANGES[table]
        old = self._stored(table).where(F.col(PART).isin(*touched))
        if newest:
            return latest(old.unionByName(rows), [key], order)
        return without_keys(old, rows.select(key), [key]).unionByName(rows)

    def _stage(self, table: str, df: DataFrame, part: Column, whole: bool = False) -> dict[str, object]:
        """Write rows beside the tables, with the partition each belongs to."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        shaped = df.withColumn(PART, part).select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields], PART)
        shaped.write.parquet(path)
        return {"table": table, "path": path, "whole": whole}

    def _put(self, staged: list[dict[str, object]]) -> None:
        self.set_progress(**{_PENDING: json.dumps(staged)})
        self.finish()

    def finish(self) -> None:
        """Put the noted change in place, again if a stop came in between."""
        noted = json.loads(self.progress(_PENDING) or "[]")
        for entry in noted:
            rows = laid_out(self.spark.read.parquet(entry["path"]), entry["table"])
            _overwrite_partitions(rows, f"{self.root}/{entry['table']}", PART, entry["table"], entry["whole"])
        if noted:
            self.set_progress(**{_PENDING: "[]"})
        for entry in noted:
            remove_folder(self.spark, entry["path"])


def _overwrite_partitions(df: DataFrame, path: str, by: str, table: str = "", whole: bool = False) -> None:
    """Replace the partitions that ``df`` has rows of, or all of them."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
    for column in LOOKUPS.get(table, ()):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.block.size", ROW_GROUP_BYTES)
    writer.partitionBy(by).parquet(path)


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """``df`` range-clustered by its partitions and the layout columns of ``table``."""
    columns = [c for c in (PART, *LAYOUT.get(table, ())) if c in df.columns]
    if not columns:
        return df
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)
