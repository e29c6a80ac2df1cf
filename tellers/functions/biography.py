"""Party fields of a biography document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields are arrays so that the first of repeated elements is taken; the record
# of a malformed document is declared so that such a document gives only NULLs.
_SHAPE = "partyShortname array<string>, party array<string>, _corrupt_record string"
_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def party_of(biography: Column) -> Column:
    """Struct (short, full) of the root's direct children, NULLs where absent."""
    parsed = F.from_xml(biography, _SHAPE, _OPTIONS)
    return F.struct(
        F.get(parsed["partyShortname"], F.lit(0)).alias("short"),
        F.get(parsed["party"], F.lit(0)).alias("full"),
    )
