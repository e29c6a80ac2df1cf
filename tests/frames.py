"""A small parliament, written out."""

from __future__ import annotations

from datetime import datetime

from tellers.plans.tables import Tables
from tellers.schema import TABLES
from tellers.session import local_rows

DAY = datetime(2024, 5, 1)

ROWS = {
    "ballot_type": [(1, "Final"), (2, "Motion")],
    "vote_type": [(1, "For"), (2, "Against"), (3, "Absent")],
    "party": [(1, "A", "Alpha"), (2, "B", "Beta"), (3, "A", "Alpha Old")],
    "member": [
        (1, "Åse", "Møller", "A", 1), (2, "Bo", "Dahl", "B", 2), (3, "Cai", "Friis", None, None),
        (4, "Dag", "Juhl", "A", 3), (5, "Eva", "Kjær", "B", 2),
    ],
    "bill": [
        (10, "Miljø 100%", "grøn_a", None, "L 1", 1, 1), (11, "MILJØ x", "b", None, "L 2", 1, 1),
        (12, "a\\b", None, None, "L 3", 1, 1),
    ],
    "topic": [(1, "Energi"), (2, "Bolig"), (3, "Sundhed")],
    "bill_topic": [(10, 1), (10, 2), (10, 3), (11, 2), (None, 1)],
    "ballot": [
        (100, 1, None, True, None, DAY, 1, 10), (101, 2, None, False, None, DAY, 2, 11),
        (102, 3, "c", True, None, datetime(2024, 5, 2, 9, 30), 1, 12),
        (103, 4, None, False, "k", None, 1, None), (104, 5, None, True, None, DAY, 9, 99),
    ],
    "vote": [
        (1, 100, 1, 1), (2, 100, 2, 2), (3, 100, 3, 1), (4, 100, 4, 1), (5, 101, 1, 3),
        (6, 101, 2, 2), (7, 102, 1, 1), (8, 104, 1, 7), (9, 999, 1, 1), (10, 102, 77, 2),
    ],
}


def frames(spark, **other):
    rows = {**ROWS, **other}
    return Tables.of(**{n: local_rows(spark, r, TABLES[n]) for n, r in rows.items()})


def rows(df, *names):
    return [tuple(r[n] for n in (names or df.columns)) for r in df.collect()]
