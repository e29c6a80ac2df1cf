"""Topics for bills: what to label, prompts, answers, and their rows."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.functions.responses import labelled_items
from tellers.functions.text import first_filled
from tellers.operators.keyed import new_rows
from tellers.operators.numbering import number_rows
from tellers.operators.sizing import splittable_join
from tellers.schema import TOPIC_NAMES

BATCH_SIZE = 15  # fixed value: bills in one prompt
RESUME_LENGTH = 300  # fixed value: characters of a resume in a prompt

NO_TITLE = "Uden titel"  # fixed value: stands for a missing title

# The keys of the answer, sag_id and kategorier.
DEFAULT_INSTRUCTIONS = (
    "Below is a numbered list of bills, each with its id, its title and a short resume. "
    "Decide what each bill is about and file it under the headings that fit, one or several:\n\n"
    "{topics}\n\n"
    "Use the headings exactly as written. Reply with nothing but JSON, an array that has an "
    'object for each bill: {{"sag_id": <id>, "kategorier": [<heading>, ...]}}\n\n'
)


def unlabelled_bills(
    bills: DataFrame, bill_topic: DataFrame, ordered: bool = True
) -> DataFrame:
    """Bills without a topic that have some title. NULL keys label nothing.

    Sorted by id unless what follows sorts anyway, as the prompts do.
    """
    labelled = bill_topic.select(F.col("bill_id").alias("id")).distinct()
    titled = bills.where(F.col("title").isNotNull() | F.col("short_title").isNotNull())
    open_bills = splittable_join(
        titled.select("id", "title", "short_title", "resume"), labelled, ["id"], "left_anti"
    )
    return open_bills.orderBy("id") if ordered else open_bills


def instructions(topics: Sequence[str] = TOPIC_NAMES, template: str = DEFAULT_INSTRUCTIONS) -> str:
    return template.format(topics="\n".join(f"- {name}" for name in topics))


def prompt_batches(
    bills: DataFrame, head: str | None = None, batch_size: int = BATCH_SIZE,
    resume_length: int | None = RESUME_LENGTH,
) -> DataFrame:
    """(batch, bills, prompt): bills in id order, numbered inside their batch.

    A resume longer than ``resume_length`` characters is shown up to there with an
    ellipsis; None shows it in whole. That is done before anything is shuffled.
    """
    head = instructions() if head is None else head
    title = F.coalesce(first_filled(F.col("title"), F.col("short_title")), F.lit(NO_TITLE))
    resume = F.coalesce(first_filled(F.col("resume"), F.col("short_title")), F.lit(""))
    short = resume if resume_length is None else F.when(
        F.length(resume) > resume_length,
        F.concat(F.substring(resume, 1, resume_length), F.lit("...")),
    ).otherwise(resume)
    texts = bills.select("id", title.alias("_title"), short.alias("_resume"))
    place = F.col("_n") - 1
    item = F.concat(
        F.col("_pos"), F.lit(". [id="), F.col("id"), F.lit("] "), F.col("_title"),
        F.lit("\n   Resume: "), F.col("_resume"), F.lit("\n\n"),
    )
    return (
        number_rows(texts, "id", "_n")
        .withColumns({
            "batch": F.floor(place / batch_size),
            "_pos": (place % batch_size + 1).cast("int"),
        })
        .withColumn("_item", item)
        .groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("bills"),
            F.expr("listagg(_item, '') WITHIN GROUP (ORDER BY _pos)").alias("_items"),
        )
        .select("batch", "bills", F.concat(F.lit(head), F.col("_items")).alias("prompt"))
    )


@dataclass(frozen=True)
class Pace:
    """How a task calls: starts a second, calls under way at once, tries, and waits between tries.

    The wait doubles with each try of a prompt, up to ``longest_wait`` seconds.
    """

    per_second: float | None = None
    at_once: int = 1
    tries: int = 1
    first_wait: float = 1.0
    longest_wait: float = 60.0

    def __post_init__(self) -> None:
        if self.at_once < 1 or self.tries < 1 or (self.per_second is not None and self.per_second <= 0):
            raise ValueError("a pace needs a rate above 0, one call at once and one try at least")


class _Caller:
    """Calls of one task, started at a pace, each tried again after a failure."""

    def __init__(self, ask: Callable[[str], str], pace: Pace) -> None:
        self._ask, self._pace = ask, pace
        self._turn, self._free_at = threading.Lock(), 0.0

    def _wait_for_turn(self) -> None:
        if self._pace.per_second is None:
            return
        with self._turn:
            start = max(self._free_at, time.monotonic())
            self._free_at = start + 1 / self._pace.per_second
        time.sleep(max(0.0, start - time.monotonic()))

    def __call__(self, prompt: str) -> tuple[str | None, str | None]:
        """(response, error): the error of the last try, if no try succeeded."""
        error = None
        for attempt in range(self._pace.tries):
            if attempt:
                time.sleep(min(self._pace.longest_wait, self._pace.first_wait * 2 ** (attempt - 1)))
            self._wait_for_turn()
            try:
                return self._ask(prompt), None
            except Exception as raised:  # noqa: BLE001 - the caller's function may raise anything
                error = str(raised)
        return None, error


def label_batches(
    prompts: DataFrame, ask: Callable[[str], str], tasks: int | None = None, pace: Pace = Pace()
) -> DataFrame:
    """(batch, response, error): one call of ``ask`` per prompt, in ``tasks`` tasks.

    ``pace`` holds for each task, so ``tasks`` times its rate is the most that a service
    sees. Calls of a task under way at once are threads, since a call waits long.

    The prompts are dealt evenly to the tasks, by default as many as the cluster runs
    at once, since a call waits long and a prompt is short.

    A call that fails gives a row without a response and the rest goes on. Write
    the result (``Store`` or ``cut``) before parsing it, so that a later failure
    does not call again.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(ask, pace)
        pool = ThreadPoolExecutor(pace.at_once) if pace.at_once > 1 else None
        for frame in frames:
            answers = list(pool.map(caller, frame["prompt"])) if pool else [caller(p) for p in frame["prompt"]]
            yield pd.DataFrame({
                "batch": frame["batch"],
                "response": pd.Series([a for a, _ in answers], dtype="object", index=frame.index),
                "error": pd.Series([e for _, e in answers], dtype="object", index=frame.index),
            })

    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    columns = prompts.select("batch", "prompt").repartition(tasks)
    return columns.mapInPandas(call, "batch BIGINT, response STRING, error STRING")


def parse_responses(responses: DataFrame) -> DataFrame:
    """(batch, bill_id, topic): one row per bill and topic name of a readable response."""
    return (
        responses.select("batch", F.inline(labelled_items(F.col("response"))))
        .select("batch", F.expr("try_cast(sag_id AS BIGINT)").alias("bill_id"), "kategorier")
        .select("batch", "bill_id", F.explode("kategorier").alias("topic"))
    )


def rejected_responses(responses: DataFrame) -> DataFrame:
    """The responses that are missing or not one JSON array."""
    return responses.where(labelled_items(F.col("response")).isNull())


def matched_labels(parsed: DataFrame, topics: DataFrame) -> DataFrame:
    """(batch, bill_id, topic_id) of the known topic names, repeats included."""
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    return splittable_join(parsed, names, ["topic"], "inner").select("batch", "bill_id", "topic_id")


def label_counts(parsed: DataFrame, topics: DataFrame) -> DataFrame:
    """Label attempts per batch, those already stored included."""
    return matched_labels(parsed, topics).groupBy("batch").agg(F.count(F.lit(1)).alias("labels"))


def _bill_keys(bills: DataFrame) -> DataFrame:
    return bills.select(F.col("id").alias("bill_id"))


def orphan_labels(parsed: DataFrame, topics: DataFrame, bills: DataFrame) -> DataFrame:
    """Labels of bills that do not exist, or of none."""
    return splittable_join(
        matched_labels(parsed, topics), _bill_keys(bills), ["bill_id"], "left_anti"
    )


def new_labels(
    parsed: DataFrame, topics: DataFrame, bills: DataFrame, bill_topic: DataFrame
) -> DataFrame:
    """(bill_id, topic_id) to append: known topics and bills, not stored yet."""
    pair = ["bill_id", "topic_id"]
    labels = matched_labels(parsed, topics).select(*pair).distinct()
    known = splittable_join(labels, _bill_keys(bills), ["bill_id"], "left_semi")
    return new_rows(bill_topic, known, pair, pair)


def ingest_labels(
    parsed: DataFrame, topics: DataFrame, bills: DataFrame, bill_topic: DataFrame
) -> DataFrame:
    """``bill_topic`` with the new labels; stored pairs stay."""
    return bill_topic.unionByName(new_labels(parsed, topics, bills, bill_topic))
