"""Text rules: case-folded LIKE, stripping, fallbacks, flags."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_like(column: Column, needle: str) -> Column:
    """``column LIKE '%needle%'`` with ASCII-only case folding.

    ``%`` and ``_`` in the needle stay wildcards and a backslash is an ordinary
    character, so LIKE gets an escape character the needle does not hold.
    """
    folded = needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    escape = next(chr(c) for c in range(1, 0x110000) if chr(c) not in folded)
    lowered = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    return F.like(lowered, F.lit(f"%{folded}%"), F.lit(escape))


def any_like(needle: str, *columns: Column) -> Column:
    """True where the needle is in any of the columns."""
    found = folded_like(columns[0], needle)
    for column in columns[1:]:
        found = found | folded_like(column, needle)
    return found


def strip(column: Column) -> Column:
    """Remove leading and trailing white space of every kind, line ends included."""
    return F.regexp_replace(column, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither NULL nor empty, else NULL."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def parse_flag(text: str | None) -> bool | None:
    """A flag given as text: nothing is no filter, "true" is true, the rest false."""
    if text is None or text == "":
        return None
    return text.lower() == "true"
