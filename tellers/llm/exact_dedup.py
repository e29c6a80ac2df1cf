"""Exact duplicates: groups of equal texts, and the row of each that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.llm.text import one_space


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after each run of spaces became
    one blank. The rows are grouped by a 128-bit hash of that text together with
    the text itself, so rows whose hashes collide fall into different groups.
    Copies meet on the map side first: a group of any size is one row per map
    task. The way back to the rows is a join of hashes alone, which AQE can split
    where one text holds much of the table.

    NULL text is the empty text, and empty texts are a group as any other. A NULL
    key is never the smallest one unless the group has no other. Rows that repeat a
    key with an equal text are one document and stay or go together. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), one_space(F.col(f"`{text}`")).alias("body"))
    hashes = (F.md5("body").alias("hash"), F.sha2("body", 256).alias("text_sha256"))
    groups = (
        rows.groupBy(F.md5("body").alias("hash"), "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return rows.select("id", *hashes).join(groups, ["hash", "text_sha256"]).select(
        F.col("id").alias(key), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
