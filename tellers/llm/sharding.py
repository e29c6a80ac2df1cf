"""Placement of documents on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.text import text_hash, whole_text
from tellers.session import local_rows

SHARDS = tuple(f"shard-{n:02d}" for n in range(32))
SLOTS = 4099  # a prime, over a hundred slots for each shard
MAX_SLOTS = 1_000_003  # bounds the table that is broadcast


def _name_hash(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of each slot.

    Each shard prefers the slots in an order of its own: from an offset, by a step,
    both hashes of its name; with a prime number of slots the step visits all. The
    shards take turns, each claiming the first slot of its order that is free, so
    their numbers of slots differ by one at most and a shard that is added or
    leaves moves few other slots.
    """
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    at = [_name_hash(f"{name}/offset") % slots for name in shards]
    step = [_name_hash(f"{name}/step") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        n = turn % len(shards)
        while owner[at[n]] is not None:
            at[n] = (at[n] + step[n]) % slots
        owner[at[n]] = shards[n]
    return owner


def placement_key(key: str, text: str) -> Column:
    """What a document is placed by: its key or, without one, its text."""
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text:"), F.md5(whole_text(F.col(f"`{text}`")))))


def assign_shards(
    docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS,
    key: str = "doc_id", text: str = "text", slot_name: str = "slot", shard_name: str = "shard",
) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``: one hash and one look into a broadcast table.

    The table has ``slots`` rows, a parameter of at most ``MAX_SLOTS``, whatever the
    size of ``docs``; no row is shuffled. Rows of one key go to one shard. A row with
    a NULL key is placed by its text, NULL text as the empty one. Columns of ``docs``
    stay as they are, but for columns named as the two results, which are replaced.
    """
    table = local_rows(
        docs.sparkSession,
        list(enumerate(lookup_table(shards, slots))),
        T.StructType().add("_slot_of_table", "long").add("_shard_of_slot", "string"),
    )
    kept = [f"`{c}`" for c in docs.columns if c not in (slot_name, shard_name)]
    placed = docs.select(*kept, (text_hash(placement_key(key, text)) % slots).alias("_slot_of_row"))
    joined = placed.join(F.broadcast(table), F.col("_slot_of_row") == F.col("_slot_of_table"))
    return joined.select(*kept, F.col("_slot_of_row").alias(slot_name), F.col("_shard_of_slot").alias(shard_name))
