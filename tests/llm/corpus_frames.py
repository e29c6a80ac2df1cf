"""Small tables of documents."""

from __future__ import annotations

from pyspark.sql import types as T

from tellers.session import local_rows

DOCUMENT = (
    T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string")
    .add("source", "string").add("n_chars", "long")
)
FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "\t\n", "word", "a b c", "Ünï çødé \U0001f600 end.", "x" * 50_000, "la " * 20_000, "  .", "1 2 3"]


def frame(spark, rows, **extra):
    """Rows of (doc_id, text[, lang[, source]]) as documents, with constant extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
    df = local_rows(spark, full, DOCUMENT)
    for name, value in extra.items():
        df = df.selectExpr("*", f"{value!r} AS `{name}`")
    return df


def by_id(df):
    """Rows by doc_id, sorted lists where it repeats."""
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(row.asDict(recursive=True))
    return out
