"""Labelling responses: JSON text, possibly inside a code fence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellers.functions.text import strip

# A fence loses its first and its last line, whatever the last line is.
_FENCE = r"(?s)\A```[^\n]*\n(.*)\n[^\n]*\z"
_ITEMS = "array<array<struct<sag_id: string, kategorier: array<string>>>>"


def unfence(response: Column) -> Column:
    return F.regexp_replace(strip(response), _FENCE, "$1")


def labelled_items(response: Column) -> Column:
    """Array of (sag_id, kategorier), or NULL where the text is not one JSON array.

    The text is parsed as the only element of an outer array: trailing text then
    is a syntax error and a second value shows in the size. Ids are read as text
    so that a quoted id counts too.
    """
    text = unfence(response)
    outer = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), _ITEMS, {"allowSingleQuotes": "false"}
    )
    items = F.get(outer, F.lit(0))
    whole = (
        text.rlike(r"\A\s*\[")
        & (F.size(outer) == 1)
        & ~F.exists(items, lambda item: item.isNull())
    )
    return F.when(whole, items)
