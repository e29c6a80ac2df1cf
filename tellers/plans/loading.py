"""The load job: landed pages into stored tables, step by step, restartable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.operators.bitmaps import id_bitmaps, ids_among, merged_bitmaps
from tellers.operators.keyed import last_arrived, upsert
from tellers.operators.sizing import splittable_join
from tellers.plans.build import (
    build_ballots, build_bills, build_lookup, build_members, build_parties, build_votes,
)
from tellers.plans.counts import bill_changes, topic_changes
from tellers.plans.quality import SUMMARY_TABLES, table_counts
from tellers.plans.search import BILL_FIELDS, gram_index
from tellers.plans.tables import Tables
from tellers.schema import PERIOD_START, RECORDS, TOPIC_NAMES
from tellers.session import cut, local_rows, remove_cuts
from tellers.sources.landed import completeness_of, landed_pages, parse_pages, records_of
from tellers.sources.store import Store

_SEED = T.StructType().add("n", "long").add("name", "string")
LAST_STEP = "last_completed_step"


class ShortFeed(RuntimeError):
    """The landed pages of a kind are damaged or fewer than the feed declares."""


def load_lookup(target: DataFrame, records: DataFrame) -> DataFrame:
    """A lookup table with fetched records put in, the last of each id."""
    return upsert(target, build_lookup(records), ["id"], ["type"])


def seed_topics(topics: DataFrame, names: Sequence[str] = TOPIC_NAMES) -> DataFrame:
    """``topics`` with the given names it lacks; ids go on from the greatest.

    The names are a short fixed list, so numbering them in the driver is fine.
    """
    spark = topics.sparkSession
    present = topics.where(F.col("name").isin(list(names))).select("name").distinct()
    taken = {row["name"] for row in present.collect()}  # at most len(names) rows
    new = list(enumerate([n for n in names if n not in taken], 1))
    top = topics.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    added = local_rows(spark, new, _SEED).select(
        (top + F.col("n")).cast("long").alias("id"), "name"
    )
    return topics.select("id", "name").unionByName(added)


def remaining_votes(done: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed votes but for those of done ballots, a one-column DataFrame; the last to arrive of an id."""
    ballots = done.select(F.col(done.columns[0]).alias("ballot_id")).distinct()
    fresh = splittable_join(landed, ballots, ["ballot_id"], "left_anti").select(*landed.columns)
    return last_arrived(fresh)


def votes_to_add(loaded: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed votes of the ballots that are not in ``loaded``, bitmaps of ballot ids.

    The stored votes are not read: a batch costs what it holds and the bitmaps.
    """
    return remaining_votes(ids_among(landed.select("ballot_id"), loaded), landed)


def incremental_votes(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """Stored votes with the remaining landed ones: a ballot with any vote is done."""
    return stored.unionByName(remaining_votes(stored.select("ballot_id"), landed).select(*stored.columns))


def with_reason(rows: DataFrame, references: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """``rows`` with ``reason``, the first reference that names nothing, or NULL.

    ``references`` has, by the reason to give, a column and the frame whose ``id`` it
    must be one of. A column that is NULL refers to nothing.
    """
    for reason, (column, known) in references.items():
        ids = known.select(F.col("id").alias(column)).where(F.col(column).isNotNull()).distinct()
        marked = ids.withColumn(f"_known_{reason}", F.lit(True))
        rows = splittable_join(rows, marked, [column], "left")
    unknown = [
        F.when(F.col(column).isNotNull() & F.col(f"_known_{reason}").isNull(), F.lit(reason))
        for reason, (column, _) in references.items()
    ]
    found = rows.withColumn("reason", F.coalesce(*unknown))
    return found.drop(*[f"_known_{reason}" for reason in references])


def checked_votes(votes: DataFrame, members: DataFrame, vote_types: DataFrame) -> DataFrame:
    """Votes with the ``reason`` for which one is set aside, or NULL."""
    return with_reason(votes, {"member": ("member_id", members), "vote_type": ("vote_type_id", vote_types)})


def checked_ballots(ballots: DataFrame, ballot_types: DataFrame, bills: DataFrame) -> DataFrame:
    """Ballots with the ``reason`` for which one is set aside, or NULL."""
    return with_reason(ballots, {"ballot_type": ("type_id", ballot_types), "bill": ("bill_id", bills)})


def append_votes(store: Store, landed: DataFrame) -> None:
    """Append the votes of stored ballots; those of unknown members or types go to a side table.

    A ballot is done once any of its votes is stored or set aside, so a vote is set
    aside once. Which ballots are done is noted with the votes, in bitmaps of which
    only those of the new ballots' ranges are written again, and so is what the votes
    add to the members' counts.
    """
    kept = store.read("ballot").select(F.col("id").alias("ballot_id"))
    of_kept = splittable_join(landed, kept, ["ballot_id"], "left_semi")
    loaded = store.read("loaded_ballot")
    checked = cut(checked_votes(votes_to_add(loaded, of_kept), store.read("member"), store.read("vote_type")))
    new = cut(id_bitmaps(checked, "ballot_id"))
    ranges = loaded.join(new.select("bucket"), "bucket", "left_semi")
    by_bill = cut(bill_changes(checked.where("reason IS NULL"), store.read("ballot")))
    store.change(
        appends={
            "vote": checked.where("reason IS NULL"), "rejected_vote": checked.where("reason IS NOT NULL"),
            "member_bill_votes": by_bill, "member_topic_votes": topic_changes(by_bill, store.read("bill_topic")),
        },
        upserts={"loaded_ballot": (merged_bitmaps(ranges.unionByName(new)), ["bitmap"], False)},
    )
    remove_cuts(checked, new, by_bill)


def run_steps(store: Store, steps: Sequence[Callable[[], object]]) -> int:
    """Run the steps after the last completed one, noting each; return how many ran."""
    done = int(store.progress(LAST_STEP) or 0)
    for number, step in enumerate(steps[done:], done + 1):
        step()
        store.set_progress(**{LAST_STEP: number})
    return len(steps[done:])


@dataclass(frozen=True)
class Load:
    """Landed folders, one per record kind of ``RECORDS``, into a store."""

    store: Store
    landed: Mapping[str, str]
    period_start: str = PERIOD_START

    @contextmanager
    def _records(self, *kinds: str) -> Iterator[list[DataFrame]]:
        """The records of some kinds, parsed once; stops at damaged pages and at a short feed.

        The damaged pages are kept in ``rejected_page`` first. The parsed pages are
        deleted when the step ends.
        """
        spark, parsed = self.store.spark, []
        try:
            for kind in kinds:
                read = parse_pages(landed_pages(spark, self.landed[kind]), RECORDS[kind])
                pages = cut(read.withColumn("value", F.expr("IF(whole, NULL, value)")))
                parsed.append(pages)
                seen = completeness_of(pages).first()
                if seen["damaged"]:
                    damaged = pages.where("NOT whole").select(F.lit(kind).alias("kind"), F.col("value").alias("page"))
                    others = self.store.read("rejected_page").where(F.col("kind") != kind)
                    self.store.write("rejected_page", others.unionByName(damaged))
                if not seen["complete"]:
                    raise ShortFeed(f"{kind}: {seen.asDict()}")
            yield [records_of(pages, F.col("page_arrival")) for pages in parsed]
        finally:
            remove_cuts(*parsed)

    def lookups(self) -> None:
        for name in ("ballot_type", "vote_type"):
            with self._records(name) as [records]:
                self.store.upsert(name, build_lookup(records), ["type"])

    def actors(self) -> None:
        with self._records("actor") as [records]:
            actors = last_arrived(records)
            for name, build in (("party", build_parties), ("member", build_members)):
                rows = build(actors)
                self.store.upsert(name, rows, [c for c in rows.columns if c not in ("id", "arrival")])

    def ballots(self) -> None:
        """Ballots of the period and their bills; a ballot of unknown type or bill is set aside."""
        with self._records("ballot", "step", "bill") as [ballots, steps, bills]:
            rows = cut(build_ballots(ballots, steps, self.period_start))
            known = cut(build_bills(bills, rows))
            self.store.change(
                appends={"bill_gram": gram_index(known, BILL_FIELDS)}, upserts={"bill": (known, ["title"], False)}
            )
            checked = cut(checked_ballots(rows, self.store.read("ballot_type"), self.store.read("bill")))
            self.store.write("rejected_ballot", checked.where("reason IS NOT NULL"))
            self.store.upsert("ballot", checked.where("reason IS NULL").drop("reason"), ["held_at"])
            remove_cuts(rows, known, checked)

    def topics(self) -> None:
        self.store.write("topic", seed_topics(self.store.read("topic")))

    def votes(self) -> None:
        with self._records("vote") as [records]:
            append_votes(self.store, build_votes(records))

    def run(self) -> DataFrame:
        """All steps that are not done yet, then the row counts."""
        run_steps(
            self.store, [self.lookups, self.actors, self.ballots, self.topics, self.votes]
        )
        return table_counts(Tables.of_store(self.store, SUMMARY_TABLES))

    def run_if_empty(self) -> DataFrame | None:
        """The load, only where no ballot is stored yet."""
        return self.run() if self.store.read("ballot").isEmpty() else None
