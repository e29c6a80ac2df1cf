"""Line quality: a linear-chain conditional random field marks each line good or bad.

The score of a line is linear in what can be counted in it and in the lines beside it;
pairs of neighbouring lines that are both good, or both bad, have a score of their own.
Marginals come from the forward and the backward recursion. With two labels both carry
one number a line, the log-odds of good, and a step of either is the same function. A
text's quality is the mean of its lines' probabilities, weighed by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.batches import by_bytes, portions, with_text_columns
from tellers.llm.text import whole_text

TRAIN_DOCS = 4_000  # labelled documents of either quality to learn from, about
TRAIN_LINES = 200  # documents of more lines are not learned from; with TRAIN_DOCS the bound of the sample
STEPS = 200
PENALTY = 1e-3
_CHARS_AT_ONCE = 1 << 20
_SHARE = 1_000_000
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*|^~<>{}[]\\=+_@/`", b"!?", b".,;:",
    bytes(range(128, 256)),
)
OWN = len(_CLASSES) + 6  # numbers of a line itself


@dataclass(frozen=True)
class LineModel:
    """Log-odds of a line: ``(x - mean) / spread @ weights``; ``good`` and ``bad`` are of equal neighbours."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    good: float
    bad: float


def own_features(line: str) -> list[float]:
    """What is counted in a line; shares of rare things count by their square root."""
    raw, words = line.encode("utf-8", "surrogatepass"), line.split()
    size, many = max(len(raw), 1), max(len(words), 1)
    distinct = len(set(words)) if words else 1
    beside = sum(map(str.__eq__, words, words[1:]))
    shares = [((len(raw) - len(raw.translate(None, c))) / size) ** 0.5 for c in _CLASSES]
    return [
        1.0, *shares, float(not words), np.log1p(len(words)), 1 - distinct / many, (beside / many) ** 0.5, len(raw) / many / 10,
    ]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, the lines' lengths, and each text's number of lines.

    A line has its own numbers, those of the line before and those of the line after,
    which are zero where there is none. A text without a line feed is one line.
    """
    split = [t.split("\n") for t in texts]
    counts = np.array([len(lines) for lines in split], dtype=np.int64)
    own = np.array([own_features(line) for lines in split for line in lines], dtype=np.float32).reshape(-1, OWN)
    lengths = np.array([len(line) + 1 for lines in split for line in lines], dtype=np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    begins = np.cumsum(counts) - counts
    before[begins] = 0
    after[begins + counts - 1] = 0
    return np.hstack([own, before, after]), lengths, counts


def _step(odds: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Log-odds that a neighbour's label passes on."""
    return np.logaddexp(odds + good, 0) - np.logaddexp(odds, bad)


def recursions(emission: np.ndarray, counts: np.ndarray, good: float, bad: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each line from what precedes it, itself included, and from what follows.

    All texts take a step together, the longest ones to the end.
    """
    order = np.argsort(-counts, kind="stable")
    begins, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    forward, backward = emission.copy(), np.zeros_like(emission)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")  # texts of more than t lines
    for t in range(1, longest):
        at = begins[:active[t]] + t
        forward[at] += _step(forward[at - 1], good, bad)
    for t in range(longest - 2, -1, -1):
        at = begins[:active[t + 1]] + t
        backward[at] = _step(emission[at + 1] + backward[at + 1], good, bad)
    return forward, backward


def marginals(emission: np.ndarray, counts: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Probability of good for each line."""
    forward, backward = recursions(emission, counts, good, bad)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))


def gradient(
    x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, theta: np.ndarray
) -> np.ndarray:
    """Of the weighed log-likelihood of texts all of whose lines have the text's label.

    ``theta`` holds the feature weights, then the scores of two good and two bad neighbours.
    """
    good, bad = theta[-2:]
    emission = x @ theta[:-2]
    forward, backward = recursions(emission, counts, good, bad)
    of = np.repeat(np.arange(len(counts)), counts)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    pair = np.flatnonzero(of[1:] == of[:-1])
    into = emission[pair + 1] + backward[pair + 1]
    scores = np.stack([forward[pair] + good + into, np.full(len(pair), bad), forward[pair], into])
    scores = np.exp(scores - scores.max(axis=0, initial=-np.inf)) if len(pair) else scores
    scores /= scores.sum(axis=0)
    of_line, of_pair = weights[of], weights[of[pair]]
    y = labels[of[pair]]
    return np.concatenate([
        x.T @ ((labels[of] - p) * of_line), [(of_pair * (y - scores[0])).sum(), (of_pair * (1 - y - scores[1])).sum()],
    ])


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> LineModel:
    """Maximise the penalised likelihood by steps with a momentum and a scale per parameter."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[spread < 1e-6], spread[spread < 1e-6] = 0, 1
    scaled = ((x - mean) / spread).astype(np.float64)
    total, theta = weights.sum(), np.zeros(x.shape[1] + 2)
    slow, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = gradient(scaled, counts, labels, weights, theta) / total - PENALTY * theta
        slow, square = 0.9 * slow + 0.1 * g, 0.99 * square + 0.01 * g * g
        rate = 0.2 * (1 - step / (steps + 1))
        theta = theta + rate * (slow / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return LineModel(mean, spread, theta[:-2], float(theta[-2]), float(theta[-1]))


def score(model: LineModel, texts: list[str]) -> np.ndarray:
    """Quality of each text from 0 to 1."""
    out = np.zeros(len(texts))
    for a, b in portions(texts, _CHARS_AT_ONCE):
        x, lengths, counts = line_features(texts[a:b])
        p = marginals((x - model.mean) / model.spread @ model.weights, counts, model.good, model.bad)
        begins = np.cumsum(counts) - counts
        out[a:b] = np.add.reduceat(p * lengths, begins) / np.add.reduceat(lengths, begins)
    return np.clip(out, 0, 1)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    documents: int = TRAIN_DOCS, lines: int = TRAIN_LINES, steps: int = STEPS,
) -> LineModel:
    """Learn from a bounded sample of labelled documents; all lines of one have its label.

    Of each quality about ``documents`` ids are drawn by their hash, the same on every
    run; of several labels of an id the greatest counts. An id that several rows share
    and a text of more than ``lines`` lines are not learned from. The lines' numbers,
    ``documents * lines`` rows of either quality at most, reach the driver, where the
    model is fitted. The qualities weigh as they occur. Without any labelled row every
    text scores one half.
    """
    id_, value = F.col(f"`{key}`"), F.col(f"`{label}`")
    judged = labels.select(id_.alias("id"), (value == 1).alias("good")).where("id IS NOT NULL AND good IS NOT NULL")
    judged = judged.groupBy("id").agg(F.max("good").alias("good"))
    sizes = {row["good"]: row["n"] for row in judged.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.lit(0)
    for good, n in sizes.items():
        share = F.when(F.col("good") == good, min(_SHARE, -(-documents * _SHARE // n))).otherwise(share)
    drawn = F.broadcast(judged.where(F.pmod(F.xxhash64("id"), F.lit(_SHARE)) < share))  # about 2 * documents rows
    named = docs.select(id_.alias("id"))
    single = named.join(drawn, "id").groupBy("id", "good").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    bodies = docs.select(id_.alias("id"), whole_text(F.col(f"`{text}`")).alias("body"))
    sample = bodies.join(F.broadcast(single.select("id", "good")), "id").where(F.regexp_count("body", F.lit("\n")) < lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2):
                texts = part.column(2).to_pylist()
                x, _, counts = line_features(texts)
                ends = np.cumsum(counts)
                packed = [x[end - n:end].tobytes() for end, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["id", "good", "x"])

    schema = T.StructType([sample.schema["id"], T.StructField("good", T.BooleanType()), T.StructField("x", T.BinaryType())])
    rows = sample.select("id", "good", "body").mapInArrow(run, schema).toArrow().sort_by("id")
    width = 3 * OWN
    if not rows.num_rows:
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)
    x = np.concatenate([np.frombuffer(raw, np.float32).reshape(-1, width) for raw in rows["x"].to_pylist()])
    counts = np.array([len(raw) // (4 * width) for raw in rows["x"].to_pylist()])
    good = np.array(rows["good"].to_pylist(), dtype=float)
    weights = np.where(good == 1, sizes.get(True, 0) / max(good.sum(), 1), sizes.get(False, 0) / max((1 - good).sum(), 1))
    return fit(x, counts, good, weights, steps)


def rate(
    docs: DataFrame, model: LineModel, text: str = "text", score_name: str = "score", keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``score``, the quality from 0 to 1 of each whole text.

    A NULL text counts as empty and is one empty line; so does an empty one. Equal
    texts score alike. Other columns stay (``keep`` names them, all by default), but
    for one with the name of the result, which is replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType().add(score_name, "double")
    return with_text_columns(
        docs, whole_text(F.col(f"`{text}`")), lambda texts: [pa.array(score(shared.value, texts), pa.float64())], added, keep
    )
