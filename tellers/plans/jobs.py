"""Jobs over a store: labelling with a caller's model, and the repairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.plans import labelling, repair
from tellers.operators.numbering import number_rows
from tellers.plans.counts import relabelled, summed, BY_BILL
from tellers.plans.loading import append_votes
from tellers.schema import RECORDS
from tellers.session import cut, remove_cuts
from tellers.sources.landed import read_pages
from tellers.sources.store import Store
from tellers.streaming.votes import fold_log

_LABELLING = "labelling"


@dataclass(frozen=True)
class LabelJob:
    """Ask for the topics of all bills that have none and store what comes back.

    Prompts are written once. Answers are stored raw, ``batches_per_commit`` at a
    time, so that a stop loses the calls of one commit at most and a restart asks
    for the batches without an answer only. Labels are stored when all have been
    asked for; batches whose call failed are asked again by the next run.
    """

    store: Store
    ask: Callable[[str], str]
    tasks: int | None = None
    batches_per_commit: int = 1000
    pace: labelling.Pace = labelling.Pace()

    def _unanswered(self) -> DataFrame:
        answered = self.store.read("response").where("response IS NOT NULL").select("batch").distinct()
        return self.store.read("prompt").join(answered, "batch", "left_anti")

    def prompts(self) -> None:
        if self.store.progress(_LABELLING) != "asking":
            bills = labelling.unlabelled_bills(self.store.read("bill"), self.store.read("bill_topic"), ordered=False)
            self.store.write("response", self.store.read("response").limit(0))
            self.store.write("prompt", labelling.prompt_batches(bills))
            self.store.set_progress(**{_LABELLING: "asking"})

    def ask_all(self) -> None:
        """Ask in portions; which prompts are open is found once, and each portion reads its own."""
        numbered = number_rows(self._unanswered(), "batch", "n").withColumn("portion", F.expr(f"(n - 1) div {self.batches_per_commit}"))
        opened = cut(numbered.repartitionByRange("n").sortWithinPartitions("n"))
        portions = opened.agg(F.max("portion")).first()[0]
        for at in range(0 if portions is None else portions + 1):
            portion = opened.where(F.col("portion") == at)
            answers = cut(labelling.label_batches(portion, self.ask, self.tasks, self.pace))
            self.store.append(response=answers)
            remove_cuts(answers)
        remove_cuts(opened)

    def labels(self) -> None:
        parsed = labelling.parse_responses(self.store.read("response"))
        new = labelling.new_labels(
            parsed, self.store.read("topic"), self.store.read("bill"), self.store.read("bill_topic")
        )
        labels, by_bill = self.store.read("bill_topic"), summed(self.store.read("member_bill_votes"), BY_BILL)
        new = cut(new)
        changes = cut(relabelled(by_bill, labels, labels.unionByName(new)))
        self.store.append(bill_topic=new, member_topic_votes=changes)
        remove_cuts(new, changes)
        if self._unanswered().isEmpty():
            self.store.set_progress(**{_LABELLING: "done"})

    def run(self) -> DataFrame:
        """All of it; returns the attempts stored per batch."""
        self.prompts()
        self.ask_all()
        self.labels()
        return labelling.label_counts(labelling.parse_responses(self.store.read("response")), self.store.read("topic"))


def store_log(store: Store, log: str) -> None:
    """Take the votes of a stream's log into the store, by the rules of the load.

    Run it while no ballot is half way through the stream: a ballot with any stored
    vote is done.
    """
    fold_log(store, log)
    append_votes(store, store.read("streamed_vote"))


@dataclass(frozen=True)
class RepairJob:
    """Landed actors and bills, read again, to repair parties, members and bill numbers."""

    store: Store
    landed: Mapping[str, str]

    def _records(self, kind: str) -> DataFrame:
        return read_pages(self.store.spark, self.landed[kind], RECORDS[kind])

    def parties(self) -> None:
        """Parties that biographies name, then the members' parties."""
        parsed = cut(repair.member_parties(self._records("actor"), "arrival"))  # parse every biography once
        parties = self.store.write("party", repair.add_parties(self.store.read("party"), parsed))
        self.store.write("member", repair.repair_members(self.store.read("member"), parsed, parties))
        remove_cuts(parsed)

    def numbers(self) -> DataFrame:
        """The bills' numbers; returns how many have one."""
        records = self._records("bill")
        bills = self.store.read("bill")
        counted = cut(repair.numbered_bills(bills, records))
        self.store.write("bill", repair.repair_numbers(bills, records))
        return counted
