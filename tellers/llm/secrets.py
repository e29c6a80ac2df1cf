"""Secrets in texts: patterns of credentials, and strings of high entropy."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellers.llm.text import whole_text

# The kinds in the order of their listing, with pattern, the group
# whose length counts, and the least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

WINDOW = 20
PIECE = 500  # characters of a long candidate at a time
# Character classes of candidates: name, characters, least bits a character in some window.
CLASSES = (("hexstring", "0-9A-Fa-f", 3.3), ("base64", "A-Za-z0-9+/_=-", 3.8))
# Strings that look random and are not secrets: UUIDs, one letter or digit over and
# over, runs of the alphabet and of digits, words of examples.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(.)\1+$|"
    r"abcdefgh|12345678|01234567|example|placeholder|changeme|xxxxxx"
)


_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
_CODES = 127  # characters that are counted apart; one beyond ASCII counts as the last


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _spans(kind: str, pieces: Column, matches: Column, counted: Column, least: int, rank: int) -> Column:
    """Array of (start, end, rank, kind) from the pieces between matches and the matches.

    A span starts where all pieces and matches before it end; lengths count code
    points. Matches whose counted part is shorter than ``least`` give none. To append
    to a list copies it, so n matches are taken in blocks of about the root of n: each
    block lists its spans from its own start, and the blocks' lengths then move them.
    """
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["value"])
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")
        )
        found = F.when(F.length(x["counted"]) >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    def in_blocks(parts: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(parts).cast("double"))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), width)
        empty = F.struct(zero.alias("at"), F.array().cast(_SPAN).alias("spans"))
        return _let(F.transform(starts, lambda at: F.aggregate(F.slice(parts, at, width), empty, step)), moved)

    def moved(blocks: Column) -> Column:
        begins = F.aggregate(
            blocks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("each")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["each"], acc["at"]).alias("each")),
            lambda acc: acc["each"],
        )
        return F.flatten(F.zip_with(blocks, begins, lambda b, begin: F.transform(b["spans"], lambda s: F.struct(
            (s["start"] + begin).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"),
            (s["end"] + begin).alias("end"), s["value"].alias("value"),
        ))))

    parts = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("value"), counted.alias("counted")
    )
    return _let(parts, in_blocks)


def _found(text: Column, kind: str, pattern: str, group: int, least: int, rank: int, likely: str) -> Column:
    """Spans of one kind; a text without anything likely is only searched once."""
    def of(matches: Column) -> Column:
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        return _spans(kind, F.split(text, pattern, -1), matches, counted, least, rank)

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.when(F.regexp_like(text, F.lit(likely)), spans).otherwise(F.array().cast(_SPAN))


def most_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of ``window`` characters in a row.

    To find a character in a string takes time that grows with its place, so a long
    value is cut into pieces, each with the start of the next one, so that every
    window is whole in some piece.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: F.substring(value, at, F.lit(PIECE + window - 1)))
    return F.array_max(F.transform(pieces, lambda piece: _entropy_of_piece(piece, window)))


def _entropy_of_piece(value: Column, window: int) -> Column:
    """The largest entropy of a short value's windows.

    Each character has its count, kept as the window slides: with S the sum of
    c*log2(c) over the counts c, the entropy is log2(window) - S/window, and a
    character that enters or leaves changes its own count and one term of S. The
    counts are a text, in which the letter at a character's code stands for its count.
    """
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    letters = F.split(value, "")
    every = F.transform(F.slice(letters, F.lit(1), F.length(value)), lambda c: F.least(F.greatest(F.ascii(c), F.lit(1)), F.lit(_CODES)))

    def term(n: Column) -> Column:
        return F.element_at(table, (n + 1).cast("int"))

    def changed(state: Column, code: Column, by: int) -> Column:
        """(counts, s) with one more, or one less, of a character."""
        n = F.ascii(F.substring(state["counts"], code, F.lit(1))) - ord("0")
        counts = F.overlay(state["counts"], F.char((n + by + ord("0")).cast("long")), code, 1)
        return F.struct(counts.alias("counts"), (state["s"] + term(n + by) - term(n)).alias("s"))

    def slide(codes: Column) -> Column:
        def step(acc: Column, at: Column) -> Column:
            same = F.struct(acc["counts"].alias("counts"), acc["s"].alias("s"))
            left = F.when(at > window, changed(acc, F.get(codes, at - window - 1), -1)).otherwise(same)
            now = _let(left, lambda state: changed(state, F.get(codes, at - 1), 1))
            return _let(now, lambda state: F.struct(
                state["counts"].alias("counts"), state["s"].alias("s"),
                F.greatest(acc["bits"], F.when(at >= window, math.log2(window) - state["s"] / window).otherwise(F.lit(0.0))).alias("bits"),
            ))

        start = F.struct(F.lit("0" * _CODES).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("bits"))
        places = F.slice(F.sequence(F.lit(1), F.greatest(F.size(codes), F.lit(1))), F.lit(1), F.size(codes))
        return F.aggregate(places, start, step, lambda acc: acc["bits"])

    return _let(every, slide)


def _looks_random(bits: float, window: int) -> Callable[[Column], Column]:
    """The test of a candidate: a digit, a letter, not allowed, and enough entropy."""

    def test(span: Column) -> Column:
        value = span["value"]
        return (
            F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
            & ~F.regexp_like(value, F.lit(ALLOWED)) & (most_entropy(value, window) >= bits)
        )

    return test


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row: key, spans of secrets, sorted by start and kind.

    A span is (start, rank, kind, end, value), in code points, the end exclusive;
    ``rank`` is the kind's place in the listing. The kinds of ``KINDS`` are patterns.
    A class of ``CLASSES`` takes as candidates its characters in a row, at least
    ``window`` of them with a digit and a letter, and keeps those that reach the
    class's entropy in some window, unless the allow list knows them.

    NULL text counts as empty and gives no span; texts of any length are searched in
    whole. Repeated rows each give a row; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    body = F.col("body")
    likely = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}
    patterns = [_found(body, kind, p, group, least, rank, likely[kind]) for rank, (kind, p, group, least) in enumerate(KINDS)]
    entropies = []
    for rank, (kind, chars, bits) in enumerate(CLASSES, len(KINDS)):
        pattern = f"[{chars}]{{{window},}}"
        candidates = _found(body, kind, pattern, 0, window, rank, f"[{chars}]{{{window}}}")

        entropies.append(F.filter(candidates, _looks_random(bits, window)))
    everything = reduce(F.concat, [*patterns, *entropies])
    return docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(f"`{text}`")).alias("body")).select(
        F.col("id").alias(key), F.array_sort(everything).alias("spans")
    )
