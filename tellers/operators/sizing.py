"""Joins whose hot partitions stay splittable.

Which side of a join is broadcast is left to Spark: it knows the size of files
before it runs, and with adaptive execution the size of every shuffled side while
it runs. Nothing is executed twice to be measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_HASHABLE = ("map", "variant")


def splittable_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str
) -> DataFrame:
    """Equi-join whose hot partitions AQE can split although a side is aggregated.

    An aggregate on the join key is already partitioned by it, so the join would
    read it without an exchange of its own, and AQE splits skewed joins only
    between two exchanges. A second key, computed from the first the same way on
    both sides, asks for a new exchange and changes no match.

    A left row with a NULL key matches nothing. Its second key comes from all its
    columns, so such rows spread over the partitions however many there are.
    """
    key = f"xxhash64({', '.join(f'`{c}`' for c in on)})"
    rest = [f"`{name}`" for name, kind in left.dtypes if not any(k in kind for k in _HASHABLE)]
    missing = " OR ".join(f"`{c}` IS NULL" for c in on)
    spread = f"CASE WHEN {missing} THEN xxhash64({', '.join(rest)}) ELSE {key} END AS _rekey"
    joined = left.selectExpr("*", spread).join(right.selectExpr("*", f"{key} AS _rekey"), [*on, "_rekey"], how)
    return joined.drop("_rekey")
