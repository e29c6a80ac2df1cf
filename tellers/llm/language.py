"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.batches import portions, with_text_columns
from tellers.llm.text import free_name
from tellers.session import cut, remove_cuts

UNDETERMINED = "und"
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_ROWS = 20_000  # labelled rows of each language to learn from, about; the bound of the sample
MAX_LANGUAGES = 200  # of one matrix, which bounds what is broadcast: 52 MB at most; more go in blocks
_CHARS_AT_ONCE = 1 << 20
_SHIFT = np.uint32(33 - FEATURES.bit_length())
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)  # odd numbers


@dataclass(frozen=True)
class LanguageModel:
    """``weights[l, f]``: log-probability of feature f in language l; ``prior``: of l.

    With more languages than a matrix takes, ``blocks`` makes models of some at a time,
    whose priors are of all, and the fields hold those of none.
    """

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    blocks: tuple[Callable[[], LanguageModel], ...] = ()


def _framed(text: str) -> list[np.ndarray]:
    """A text's code points in lower case between blanks, a very long one in pieces.

    A piece goes on into the next one by one character less than the longest n-gram.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    many = -(-len(points) // _CHARS_AT_ONCE)
    if many <= 1:
        return [points]
    size = -(-len(points) // many)
    return [points[at:at + size + max(ORDERS) - 1] for at in range(0, len(points), size)]


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all texts and the number of each text's.

    Texts are lower-cased and framed by blanks; an n-gram lies inside its frame. A text
    longer than ``_CHARS_AT_ONCE`` is taken alone, a piece at a time.
    """
    if len(texts) == 1 and len(texts[0]) >= _CHARS_AT_ONCE:
        pieces = _framed(texts[0])
        for at, piece in enumerate(pieces):
            for n, (hashed, _) in zip(ORDERS, _features([piece])):
                if at + 1 < len(pieces):  # what starts in the next piece is counted there
                    hashed = hashed[:len(piece) - max(ORDERS) + 1]
                yield hashed, np.array([len(hashed)])
        return
    yield from _features([_framed(t)[0] for t in texts])


def _features(points: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    joined = np.concatenate(points)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(joined))  # characters to the frame's end
    mix = np.zeros(len(joined), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        mix = mix[:len(joined) - n + 1] * np.uint32(31) + (joined[n - 1:] + np.uint32(1)) * _MULTIPLIERS[n - 1]
        if n in ORDERS:
            bits = mix[rest[:len(mix)] >= n]
            bits ^= bits >> np.uint32(15)
            yield (bits * np.uint32(0x2C1B3C6D)) >> _SHIFT, np.maximum(lengths - n + 1, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of a task's rows, each pair once."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in portions(texts, _CHARS_AT_ONCE):
            names, codes = np.unique(np.array(langs[a:b], dtype=str), return_inverse=True)
            for name in map(str, names):
                counts.setdefault(name, np.zeros(FEATURES, np.int64))
            for hashed, many in features(texts[a:b]):
                of = np.repeat(codes, many)
                for code, name in enumerate(map(str, names)):
                    counts[name] += np.bincount(hashed[of == code], minlength=FEATURES)
    for lang, n in counts.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())],
            ["lang", "feature", "n"],
        )


def train(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = TRAIN_ROWS,
) -> LanguageModel:
    """Learn from rows with a text and a language; of each language about ``rows`` of them.

    The sample is the rows whose hashed key falls below a share, the same on every
    run; ``rows=None`` learns from all. Counts are summed in Spark; what reaches the
    driver at a time is one number for each feature of ``MAX_LANGUAGES`` languages at
    most. Without any labelled row the model knows no language.
    """
    usable = labelled.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("body"),
        F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1_000_000)).alias("draw"),
    ).where("lang IS NOT NULL AND body IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row a language
    if not sizes:
        return LanguageModel((), np.empty(0), np.empty((0, FEATURES), np.float32))
    if rows is not None:
        share = F.lit(0)
        for size in sizes:
            share = F.when(F.col("lang") == size["lang"], min(1_000_000, -(-rows * 1_000_000 // size["n"]))).otherwise(share)
        usable = usable.where(F.col("draw") < share)
    counted = usable.select("lang", "body").mapInArrow(_count, "lang string, feature int, n bigint")
    sums = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    many = dict(map(tuple, sizes))
    languages = sorted(many)
    total = sum(many.values())

    def model_of(names: list[str], rows: DataFrame) -> LanguageModel:
        found = rows.toArrow()
        smoothed = np.full((len(names), FEATURES), SMOOTHING)
        named = found["lang"].combine_chunks().dictionary_encode()
        place = {name: at for at, name in enumerate(names)}
        of = np.array([place[name] for name in named.dictionary.to_pylist()], dtype=np.int64)[named.indices.to_numpy()]
        smoothed[of, found["feature"].to_numpy()] += found["n"].to_numpy()
        weights = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
        return LanguageModel(tuple(names), np.log(np.array([many[name] for name in names]) / total), weights)

    if len(languages) <= MAX_LANGUAGES:
        return model_of(languages, sums)
    written = cut(sums.repartitionByRange("lang"))
    parts = [languages[at:at + MAX_LANGUAGES] for at in range(0, len(languages), MAX_LANGUAGES)]
    blocks = tuple(partial(model_of, part, written.where(F.col("lang").between(part[0], part[-1]))) for part in parts)
    return LanguageModel((), np.empty(0), np.empty((0, FEATURES), np.float32), blocks)


def score(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language (its place in the model) and its posterior probability, for each text."""
    best, top, rest = log_scores(model, texts)
    return best, np.exp(top - rest)


def log_scores(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the best language, its log-score, and the log of the sum of all languages' scores."""
    best, highest, every = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for a, b in portions(texts, _CHARS_AT_ONCE):
        logs = np.tile(model.prior, (b - a, 1))
        for hashed, many in features(texts[a:b]):
            begins = np.cumsum(many) - many
            for column, weights in enumerate(model.weights):
                logs[:, column] += np.add.reduceat(weights[hashed], begins, dtype=np.float64)
        top = logs.max(axis=1)
        best[a:b], highest[a:b] = logs.argmax(axis=1), top
        every[a:b] = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    return best, highest, every


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of the language.

    A text that is NULL or has no letter, and any text when nothing was learned, is
    ``und`` with score 0. Ties go to the language that sorts first. Texts are used in
    whole. Other columns stay (``keep`` names them, all by default), but for columns
    with the names of the results, which are replaced. An empty table gives no rows.
    A model in blocks takes a pass over the texts for each block.
    """
    if model.blocks:
        return _identify_in_blocks(docs, model, text, lang_name, score_name, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body = F.col(f"`{text}`").cast("string")

    def compute(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and model.languages]
        best, sure = score(model, [texts[i] for i in known])
        for i, at in zip(known, best):
            names[i] = model.languages[at]
        scores[known] = sure
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    added = T.StructType().add(lang_name, "string").add(score_name, "double")
    return with_text_columns(docs, F.when(F.regexp_like(body, F.lit(r"\p{L}")), body), compute, added, keep)


def _identify_in_blocks(
    docs: DataFrame, model: LanguageModel, text: str, lang_name: str, score_name: str, keep: list[str] | None
) -> DataFrame:
    """``identify`` with some languages at a time: the best of all blocks, against the sum of all."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (lang_name, score_name)]
    name, best, every, new = (free_name(docs, f"_lang_{n}") for n in ("name", "best", "every", "new"))
    body = F.col(f"`{text}`").cast("string")
    lettered = F.when(F.regexp_like(body, F.lit(r"\p{L}")), body)
    found = docs.withColumns({name: F.lit(None).cast("string"), best: F.lit(None).cast("double"), every: F.lit(None).cast("double")})
    kind = T.StructType().add("name", "string").add("best", "double").add("every", "double")
    before = None
    for block in model.blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block())

        def compute(texts: list[str | None], shared=shared) -> list[pa.Array]:
            of, out = shared.value, [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for i, at, top, total in zip(known, *(x.tolist() for x in log_scores(of, [texts[i] for i in known]))):
                out[i] = {"name": of.languages[at], "best": top, "every": total}
            return [pa.array(out, pa.struct([("name", pa.string()), ("best", pa.float64()), ("every", pa.float64())]))]

        needed = list(dict.fromkeys([*kept, text, name, best, every]))
        scored = with_text_columns(found, lettered, compute, T.StructType().add(new, kind), needed)
        better = F.col(best).isNull() | (F.col(f"{new}.best") > F.col(best))
        high = F.greatest(every, f"{new}.every")
        total = F.when(F.col(every).isNull(), F.col(f"{new}.every")).otherwise(
            high + F.log1p(F.exp(F.least(every, f"{new}.every") - high)))
        merged = scored.withColumns({
            name: F.when(better, F.col(f"{new}.name")).otherwise(F.col(name)),
            best: F.when(better, F.col(f"{new}.best")).otherwise(F.col(best)), every: total,
        }).drop(new)
        found = cut(merged)
        if before is not None:
            remove_cuts(before)
        before = found
    return found.select(
        *[f"`{c}`" for c in kept], F.coalesce(name, F.lit(UNDETERMINED)).alias(lang_name),
        F.coalesce(F.exp(F.col(best) - F.col(every)), F.lit(0.0)).alias(score_name),
    )
