"""Domain tables, their constraints, and the shapes of the landed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_ID = T.LongType()
_TEXT = T.StringType()

# What orders landed records: file time, file, place of the block and of the line, place in the page.
PAGE_ARRIVAL = _table(("modified", T.TimestampType()), ("file", _TEXT), ("block", _ID), ("line", _ID))
ARRIVAL_TYPE = _table(("_page_arrival", PAGE_ARRIVAL), ("_place", T.IntegerType()))

TABLES: dict[str, T.StructType] = {
    "ballot_type": _table(("id", _ID), ("type", _TEXT)),
    "vote_type": _table(("id", _ID), ("type", _TEXT)),
    "party": _table(("id", _ID), ("abbreviation", _TEXT), ("name", _TEXT)),
    "member": _table(
        ("id", _ID), ("first_name", _TEXT), ("last_name", _TEXT),
        ("party_abbr", _TEXT), ("party_id", _ID),
    ),
    "bill": _table(
        ("id", _ID), ("title", _TEXT), ("short_title", _TEXT), ("resume", _TEXT),
        ("number", _TEXT), ("type_id", _ID), ("period_id", _ID),
    ),
    "topic": _table(("id", _ID), ("name", _TEXT)),
    "bill_topic": _table(("bill_id", _ID), ("topic_id", _ID)),
    "ballot": _table(
        ("id", _ID), ("number", _ID), ("conclusion", _TEXT), ("passed", T.BooleanType()),
        ("comment", _TEXT), ("held_at", T.TimestampNTZType()), ("type_id", _ID), ("bill_id", _ID),
    ),
    "vote": _table(("id", _ID), ("ballot_id", _ID), ("member_id", _ID), ("vote_type_id", _ID)),
    "rejected_vote": _table(
        ("id", _ID), ("ballot_id", _ID), ("member_id", _ID), ("vote_type_id", _ID), ("reason", _TEXT)
    ),
    "rejected_ballot": _table(
        ("id", _ID), ("number", _ID), ("conclusion", _TEXT), ("passed", T.BooleanType()),
        ("comment", _TEXT), ("held_at", T.TimestampNTZType()), ("type_id", _ID), ("bill_id", _ID),
        ("reason", _TEXT),
    ),
    "rejected_page": _table(("kind", _TEXT), ("page", _TEXT)),
    "streamed_vote": _table(
        ("id", _ID), ("ballot_id", _ID), ("member_id", _ID), ("vote_type_id", _ID), ("arrival", ARRIVAL_TYPE)
    ),
    "bill_gram": _table(("field", _TEXT), ("gram", _TEXT), ("range", _ID), ("places", T.ArrayType(T.IntegerType()))),
    "member_bill_votes": _table(("member_id", _ID), ("bill_id", _ID), ("vote_type_id", _ID), ("votes", _ID)),
    "member_topic_votes": _table(("member_id", _ID), ("topic_id", _ID), ("vote_type_id", _ID), ("votes", _ID)),
    "loaded_ballot": _table(("bucket", _ID), ("bitmap", T.BinaryType())),
    "prompt": _table(("batch", _ID), ("bills", _ID), ("prompt", _TEXT)),
    "response": _table(("batch", _ID), ("response", _TEXT), ("error", _TEXT)),
    "load_progress": _table(("key", _TEXT), ("value", _TEXT)),
}


@dataclass(frozen=True)
class Constraints:
    """Rules of one table: unique keys, columns that must be set, references."""

    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    references: tuple[tuple[str, str], ...] = ()  # (column, referenced table)


CONSTRAINTS: dict[str, Constraints] = {
    "ballot_type": Constraints((("id",),), ("type",)),
    "vote_type": Constraints((("id",),), ("type",)),
    "party": Constraints((("id",),), ("abbreviation",)),
    "member": Constraints((("id",),), ("first_name", "last_name"), (("party_id", "party"),)),
    "bill": Constraints((("id",),)),
    "topic": Constraints((("id",), ("name",)), ("name",)),
    "bill_topic": Constraints(
        (("bill_id", "topic_id"),), (), (("bill_id", "bill"), ("topic_id", "topic"))
    ),
    "ballot": Constraints((("id",),), (), (("type_id", "ballot_type"), ("bill_id", "bill"))),
    "vote": Constraints(
        (("id",),),
        ("ballot_id", "member_id", "vote_type_id"),
        (("ballot_id", "ballot"), ("member_id", "member"), ("vote_type_id", "vote_type")),
    ),
    "load_progress": Constraints((("key",),)),
}

# The topic names; their order gives the ids.
TOPIC_NAMES = (
    "Miljø og klima",
    "Landbrug og fødevarer",
    "Vand og vandmiljø",
    "Sundhed",
    "Forsvar og sikkerhed",
    "Skat og økonomi",
    "Social- og familiepolitik",
    "Retspolitik",
    "Udlændinge og integration",
    "Arbejdsmarked",
    "Uddannelse",
    "Transport og infrastruktur",
    "Digitalisering",
    "Erhverv og handel",
    "Kultur og medier",
    "Demokrati og institutioner",
    "Udenrigspolitik",
    "Bolig",
    "Energi",
)

# Field names and type codes of the open-data feed.
ACTOR_PERSON = 5
ACTOR_GROUP = 9
PERIOD_START = "2022-11-01"
RECORDS: dict[str, T.StructType] = {
    "ballot_type": _table(("id", _ID), ("type", _TEXT)),
    "vote_type": _table(("id", _ID), ("type", _TEXT)),
    "actor": _table(
        ("id", _ID), ("typeid", _ID), ("fornavn", _TEXT), ("efternavn", _TEXT),
        ("navn", _TEXT), ("gruppenavnkort", _TEXT), ("biografi", _TEXT),
    ),
    "ballot": _table(
        ("id", _ID), ("nummer", _ID), ("konklusion", _TEXT), ("vedtaget", T.BooleanType()),
        ("kommentar", _TEXT), ("opdateringsdato", _TEXT), ("typeid", _ID), ("sagstrinid", _ID),
    ),
    "step": _table(("id", _ID), ("dato", _TEXT), ("sagid", _ID)),
    "bill": _table(
        ("id", _ID), ("titel", _TEXT), ("titelkort", _TEXT), ("resume", _TEXT),
        ("nummer", _TEXT), ("typeid", _ID), ("periodeid", _ID),
    ),
    "vote": _table(("id", _ID), ("afstemningid", _ID), ("aktørid", _ID), ("typeid", _ID)),
}
