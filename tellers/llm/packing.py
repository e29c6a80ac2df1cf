"""Hashes of many documents as a few binary rows, dealt to buckets by hash.

One row for each hash would cost a shuffle four times its eight bytes. A row here
holds what one portion of documents has for one bucket: the hashes, and their owners
run by run. The number of buckets follows the text, so a bucket stays a few million
hashes at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES_PER_BUCKET = 16 * 1024 * 1024  # of text
LEAST_BUCKETS = 64


def buckets_for(docs: DataFrame, text: Column) -> int:
    """How many buckets the text of ``docs`` takes."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BUCKETS, size // BYTES_PER_BUCKET)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, small or rising slowly by preference, byte plane by byte plane."""
    steps = np.diff(numbers.astype(np.int64), prepend=np.int64(0))
    folded = (steps << 1 ^ steps >> 63).astype(np.uint64)  # small for small steps either way
    return zlib.compress(folded.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    folded = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum((folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64))


def pack_hashes(hashes: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    if len(sorted_keys):
        cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)]):
            yield int(sorted_keys[a]), a, b


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's owner and length."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]) if len(owner) else np.empty(0, np.int64)
    return owner[starts.astype(np.int64)], np.diff(np.append(starts, len(owner))).astype(np.int64)


def joined(parts: Iterable[np.ndarray], kind: type) -> np.ndarray:
    found = list(parts)
    return np.concatenate(found) if found else np.empty(0, kind)
