"""Words and spaces as the corpus operators understand them, in SQL and in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_HASH_DIGITS = 15  # hexadecimal digits: 60 bits, so that a BIGINT holds them


def whole_text(text: Column) -> Column:
    """The text, with nothing in place of NULL."""
    return F.coalesce(text.cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    """The text with each run of spaces replaced by one blank; NULL counts as empty."""
    return F.regexp_replace(whole_text(text), SPACES, " ")


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; NULL has none."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def text_hash(text: Column) -> Column:
    """A BIGINT from 0 to 2**60 - 1, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, _HASH_DIGITS), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name
