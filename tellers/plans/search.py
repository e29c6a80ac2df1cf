"""Search by an index of trigrams: which ids may hold a text, before any text is read.

A text that holds a needle holds every run of three characters of it. The index has, for
each field, run and range of 32,768 ids, the places of the ids whose field holds the run.
The ids that have all runs of a needle in one field are the candidates, and the LIKE that
a search would use on all rows is tried on those alone. A wildcard ends a run; a needle
without three characters in a row is searched without the index.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellers.functions.text import any_like
from tellers.operators.sizing import splittable_join
from tellers.session import cut

GRAM = 3
RANGE = 32_768  # ids of a row of the index
LISTED = 10_000  # candidates that are named to the scan one by one
BILL_FIELDS = {"title": "title", "short_title": "short_title", "number": "number"}
MEMBER_FIELDS = {
    "first_name": "first_name", "last_name": "last_name", "full_name": "concat(first_name, ' ', last_name)", "party_abbr": "party_abbr",
}


def _folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def needle_grams(needle: str) -> list[str]:
    """The distinct runs of three characters that a match must hold."""
    folded = needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return sorted({p[i:i + GRAM] for p in re.split("[%_]", folded) for i in range(len(p) - GRAM + 1)})


def gram_index(rows: DataFrame, fields: Mapping[str, str], key: str = "id") -> DataFrame:
    """(field, gram, range, places): where the fields of rows hold each run of characters.

    ``fields`` has an expression by name. Rows of later batches are indexed apart and
    added; what a changed row held before only makes it a candidate too many. A run that
    most rows hold is in as many rows of the index as there are ranges of ids.
    """
    texts = F.array(*[F.struct(F.lit(name).alias("field"), _folded(F.expr(e)).alias("text")) for name, e in fields.items()])
    long = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.inline(texts))
    starts = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring("text", at, F.lit(GRAM))))
    held = long.where(F.length("text") >= GRAM).select("id", "field", F.explode(grams).alias("gram"))
    placed = held.select(
        "field", "gram", F.floor(F.col("id") / RANGE).alias("range"), F.pmod("id", F.lit(RANGE)).cast("int").alias("place")
    )
    return placed.groupBy("field", "gram", "range").agg(F.array_sort(F.collect_set("place")).alias("places"))


def candidates(index: DataFrame, needle: str, fields: Sequence[str]) -> DataFrame | None:
    """(id): rows that have all runs of the needle in one of the fields; None if it has no run."""
    grams = needle_grams(needle)
    if not grams:
        return None
    found = index.where(F.col("gram").isin(*grams) & F.col("field").isin(*fields))
    by_gram = found.groupBy("field", "range", "gram").agg(F.flatten(F.collect_list("places")).alias("places"))
    by_range = by_gram.groupBy("field", "range").agg(F.collect_list("places").alias("lists"), F.count(F.lit(1)).alias("n"))
    shared = F.aggregate(F.slice("lists", 2, len(grams)), F.array_distinct(F.col("lists")[0]), F.array_intersect)
    whole = by_range.where(F.col("n") == len(grams)).select("range", F.explode(shared).alias("place"))
    return whole.select((F.col("range") * RANGE + F.col("place")).alias("id")).distinct()


def search(
    rows: DataFrame, needle: str, fields: Mapping[str, str], index: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """The rows of which a field holds the needle, by ``folded_like``.

    With an ``index`` the candidates are found first. Up to ``LISTED`` of them are named
    in the filter, which the scan uses to skip what has none; more are joined.
    """
    exact = any_like(needle, *[F.expr(e) for e in fields.values()])
    found = candidates(index, needle, list(fields)) if index is not None else None
    if found is None:
        return rows.where(exact)
    ids = cut(found)
    few = [row["id"] for row in ids.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return rows.where(F.col(key).isin(*few) & exact)
    return splittable_join(rows, ids.select(F.col("id").alias(key)), [key], "left_semi").select(*rows.columns).where(exact)
