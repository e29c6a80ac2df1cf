"""The tables a query runs on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.sizing import splittable_join
from tellers.sources.store import Store


class Tables:
    """Named DataFrames, each built when first asked for.

    ``bounded`` names the tables that hold few rows by construction.
    """

    def __init__(
        self, makers: Mapping[str, Callable[[], DataFrame]], bounded: Iterable[str] = ()
    ) -> None:
        self._makers = makers
        self._bounded = frozenset(bounded)
        self._built: dict[str, DataFrame] = {}

    @classmethod
    def of_store(cls, store: Store, names: Iterable[str]) -> Tables:
        return cls({name: lambda name=name: store.read(name) for name in names})

    @classmethod
    def of(cls, bounded: Iterable[str] = (), **frames: DataFrame) -> Tables:
        return cls({name: lambda df=df: df for name, df in frames.items()}, bounded)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables but for ``frames``."""
        new = Tables.of(self._bounded.difference(frames), **frames)
        new._makers = {n: lambda n=n: self[n] for n in self._makers} | dict(new._makers)
        return new

    def lookup(self, name: str, /, **columns: str) -> DataFrame:
        """Columns of a table, renamed ``new=old``; of a bounded one for broadcast."""
        chosen = self[name].selectExpr(*[f"{old} AS {new}" for new, old in columns.items()])
        return F.broadcast(chosen) if name in self._bounded else chosen


def topics_by_bill(tables: Tables, separator: str) -> DataFrame:
    """(bill_id, topics): the distinct topic names of each bill, sorted and joined.

    A set per bill is no larger than the topic table and is built on the map side
    first. Bills without a topic are not in the result, so a left join gives NULL.
    """
    return (
        tables["bill_topic"].join(tables.lookup("topic", topic_id="id", _topic="name"), "topic_id")
        .where("bill_id IS NOT NULL AND _topic IS NOT NULL")
        .groupBy("bill_id")
        .agg(F.expr(f"array_join(sort_array(collect_set(_topic)), '{separator}') AS topics"))
    )


def bill_columns(tables: Tables, *extra: str) -> DataFrame:
    return tables["bill"].selectExpr(
        "id AS bill_id", "number AS bill_number", "title", "short_title", "period_id", *extra
    )


def with_bill(rows: DataFrame, tables: Tables, separator: str, *extra: str) -> DataFrame:
    """Left-join bills and their topic lists to rows that have a ``bill_id``.

    The bill side is put together first, one row per bill. ``bill_id`` of the result
    is the bill's own key: NULL where no such bill exists.
    """
    cards = (
        bill_columns(tables, *extra)
        .join(topics_by_bill(tables, separator), "bill_id", "left")
        .selectExpr("*", "bill_id AS _bill_key")
    )
    joined = splittable_join(rows, cards, ["bill_id"], "left")
    return joined.drop("bill_id").withColumnRenamed("_bill_key", "bill_id")


def with_ballot_type(ballots: DataFrame, tables: Tables) -> DataFrame:
    names = tables.lookup("ballot_type", type_id="id", ballot_type="type")
    return ballots.join(names, "type_id", "left")


def with_vote_type(counts: DataFrame, tables: Tables, how: str = "inner") -> DataFrame:
    names = tables.lookup("vote_type", vote_type_id="id", vote_type="type")
    return counts.join(names, "vote_type_id", how)
