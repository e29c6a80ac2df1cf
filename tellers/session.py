"""Session helpers: the shared folder, cutting lineage in it, small local frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


_MADE: list[list[str]] = []  # the tables cut so far, for each ``settled`` under way


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` (or an already set checkpoint directory) wins. Where
    neither is set a session in one process gets a temporary folder; on a cluster
    that would lose rows, so it is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not _is_local(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="tellers-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from the table written to the shared folder.

    A lost executor then costs a re-read and not a re-run, and later plans see a
    Parquet scan: columnar, pruned, and of known size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written, without the tables that were cut on the way to it."""
    made: list[str] = []
    _MADE.append(made)
    try:
        df = make()
        out = cut(df)
    finally:
        _MADE.pop()  # they nest
    for path in made[:-1]:
        remove_folder(df.sparkSession, path)
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_cuts(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that are no longer read."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("cut-"):
                remove_folder(df.sparkSession, folder)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few literal rows as a local relation, whose size the optimizer knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
