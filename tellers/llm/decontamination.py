"""Benchmark decontamination: greedy string tiling of documents with test items."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellers.llm.batches import portions, with_text_columns
from tellers.llm.packing import slices
from tellers.llm.rolling import IN_PLAIN_WORD, window_hashes, word_hashes
from tellers.llm.text import free_name, whole_text

LEAST_MATCH = 5  # words of the shortest tile
COVERAGE = 0.5  # share of an item's words that tiles must cover
BLOCK_BYTES = 16 * 1024 * 1024  # bytes of item texts that are held at once
_BYTES_AT_ONCE = 1 << 20

HIT = T.StructType().add("item", "long").add("covered", "long").add("words", "long").add("coverage", "double")
_ARROW_HITS = pa.list_(pa.struct([
    ("item", pa.int64()), ("covered", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()),
]))


_NO_WORD = re.compile(r"[^\x00-\x7f\w]+")  # beyond ASCII: quotes, dashes, spaces, signs


def plain(text: str) -> bytes:
    """The text in lower case with blanks for signs beyond ASCII; those of ASCII end a word anyway."""
    lowered = text.lower()
    return (lowered if lowered.isascii() else _NO_WORD.sub(" ", lowered)).encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Items:
    """Test items as word hashes, with their seeds sorted by hash."""

    ids: np.ndarray
    words: list[np.ndarray]
    seed: np.ndarray  # hash of each window of a tile's least length, sorted
    item: np.ndarray  # where it is: the item's place in ids, and the word it starts at
    at: np.ndarray


def index_items(ids: list[int], texts: list[str], least: int = LEAST_MATCH) -> Items:
    """Items shorter than a tile have the length of a tile of their own and are left out here."""
    hashes, counts = word_hashes([plain(t) for t in texts], IN_PLAIN_WORD)
    seeds, many = window_hashes(hashes, counts, least)
    item = np.repeat(np.arange(len(ids)), many)
    at = np.arange(len(seeds)) - np.repeat(np.cumsum(many) - many, many)
    order = np.argsort(seeds, kind="stable")
    words = np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
    return Items(np.array(ids, dtype=np.int64), words, seeds[order], item[order], at[order])


def tiles(starts: np.ndarray, places: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the matching seeds of one item and one document.

    ``starts[k]`` and ``places[k]`` are the words at which seed k starts in the item
    and in the document. Seeds in a row on a diagonal are one match. The longest
    match is marked first, of equal ones the first in the item, then in the document;
    of a match that marked words cut, the free parts that are long enough go back in
    the queue. Returns (start, place, length), whose words are marked but once.
    """
    order = np.lexsort((starts, places - starts))
    s, p = starts[order], places[order]
    breaks = np.flatnonzero((np.diff(s) != 1) | (np.diff(p - s) != 0)) + 1
    begins = np.concatenate([[0], breaks])
    lengths = np.diff(np.concatenate([begins, [len(s)]])) + least - 1
    queue = [(-int(n), int(s[b]), int(p[b])) for b, n in zip(begins, lengths)]
    heapq.heapify(queue)
    in_item = np.zeros(int(s.max()) + int(lengths.max()) + 1, dtype=bool)
    in_doc: set[int] = set()
    found = []
    while queue:
        n, start, place = heapq.heappop(queue)
        free = [not in_item[start + k] and place + k not in in_doc for k in range(-n)]
        if all(free):
            found.append((start, place, -n))
            in_item[start:start - n] = True
            in_doc.update(range(place, place - n))
            continue
        run = 0
        for k, is_free in enumerate([*free, False]):
            if is_free:
                run += 1
                continue
            if run >= least:
                heapq.heappush(queue, (-run, start + k - run, place + k - run))
            run = 0
    return found


def _hits(items: Items, seeds: np.ndarray, least: int, coverage: float) -> list[dict]:
    """Items that tiles of one document, given by its seeds in order, cover enough.

    Which items can be covered is found from the document's distinct seeds, so what is
    held is bounded by the block of items however often the document repeats itself;
    matches are put together for one item at a time.
    """
    by_seed = np.argsort(seeds, kind="stable")
    in_order = seeds[by_seed]
    distinct = in_order[np.concatenate([[True], in_order[1:] != in_order[:-1]])]
    low, high = np.searchsorted(items.seed, distinct, "left"), np.searchsorted(items.seed, distinct, "right")
    found = _ranges(low, high)
    found = found[np.lexsort((items.at[found], items.item[found]))]
    out = []
    for i, a, b in slices(items.item[found]):
        start = items.at[found[a:b]]
        words = len(items.words[i])
        reach = np.zeros(words + 1, dtype=np.int64)  # no tiling covers more than the seeds do
        np.add.at(reach, start, 1)
        np.add.at(reach, start + least, -1)
        if np.count_nonzero(np.cumsum(reach)[:-1]) < coverage * words:
            continue
        wanted = items.seed[found[a:b]]
        low, high = np.searchsorted(in_order, wanted, "left"), np.searchsorted(in_order, wanted, "right")
        covered = sum(n for _, _, n in tiles(np.repeat(start, high - low), by_seed[_ranges(low, high)], least))
        if covered >= coverage * words:
            out.append({"item": int(items.ids[i]), "covered": covered, "words": words, "coverage": covered / words})
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The whole numbers from each ``low`` up to its ``high``, one range after the other."""
    many = high - low
    return np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    least: int = LEAST_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
    hits_name: str = "hits", keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``hits``: the items of which tiles cover ``coverage`` of the words or more.

    Words are lower-cased runs of letters and digits of any script. Tiles are common runs of at
    least ``least`` words, marked longest first and without overlap in item or
    document, so passages in another order or with gaps count as well. A hit is
    (item, covered, words, coverage); hits are sorted by item.

    The items are taken in blocks of about ``block_bytes`` of text, each broadcast to
    one pass over the documents, which are never shuffled; the number of blocks
    follows the benchmark. An item with fewer words than a tile is matched whole.

    NULL texts are empty and hit nothing; an item without words, a NULL item text or
    a NULL id is left out; repeated items each give a hit. Texts are searched in
    whole. Other columns stay (``keep`` names them, all by default), one named
    ``hits`` is replaced. Empty tables give no rows, or no hits.
    """
    usable = benchmark.select(
        F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("body")
    ).where("id IS NOT NULL AND body IS NOT NULL")
    size = usable.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    so_far, new = (free_name(docs, n) for n in ("_leak_hits", "_leak_new"))
    found = docs.withColumn(so_far, F.array().cast(T.ArrayType(HIT)))
    kept = [c for c in (docs.columns if keep is None else keep) if c != hits_name]
    for block in range(blocks):
        of_block = usable.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == block).orderBy("id", "body").toArrow()
        needed = kept if block == blocks - 1 else list(dict.fromkeys([*kept, text]))
        found = _pass(found, of_block["id"].to_pylist(), of_block["body"].to_pylist(), text, least, coverage, needed, so_far, new)
    return found.select(*[f"`{c}`" for c in kept], F.array_sort(so_far).alias(hits_name))


def _pass(
    docs: DataFrame, ids: list[int], texts: list[str], text: str, least: int, coverage: float, keep: list[str], so_far: str, new: str,
) -> DataFrame:
    """Append the hits of one block of items to ``so_far``."""
    counts = word_hashes([plain(t) for t in texts], IN_PLAIN_WORD)[1]
    by_least: dict[int, Items] = {}
    for width in sorted({min(least, int(n)) for n in counts if n}):
        chosen = [i for i, n in enumerate(counts) if n and min(least, int(n)) == width]
        by_least[width] = index_items([ids[i] for i in chosen], [texts[i] for i in chosen], width)
    shared = docs.sparkSession.sparkContext.broadcast(by_least)

    def compute(bodies: list[str]) -> list[pa.Array]:
        out = []
        for a, b in portions(bodies, _BYTES_AT_ONCE):
            hashes, many_words = word_hashes([plain(t) for t in bodies[a:b]], IN_PLAIN_WORD)
            hits = [[] for _ in range(a, b)]
            for width, items in shared.value.items():
                seeds, many = window_hashes(hashes, many_words, width)
                known = np.isin(seeds, items.seed)
                ends = np.cumsum(many)
                for d in np.unique(np.searchsorted(ends, np.flatnonzero(known), "right")):
                    hits[d] += _hits(items, seeds[ends[d] - many[d]:ends[d]], width, coverage)
            out += hits
        return [pa.array(out, type=_ARROW_HITS)]

    added = T.StructType().add(new, T.ArrayType(HIT))
    more = with_text_columns(docs, whole_text(F.col(f"`{text}`")), compute, added, [*keep, so_far])
    return more.withColumn(so_far, F.concat(so_far, new)).drop(new)
