"""Plain versions of the operators, one document or one pair at a time."""

from __future__ import annotations

import re
from collections import defaultdict

UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_words(texts, window):
    """{id: (words, removed flags)} of {id: text}; a key of None comes last."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i in sorted(texts, key=order):
        w = words(texts[i])
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a:a + window]), i)
    out = {}
    for i, text in texts.items():
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if order(first[tuple(w[a:a + window])]) < order(i):
                gone[a:a + window] = [True] * window
        out[i] = (w, gone)
    return out


def ngrams(text, n):
    w = (text or "").encode().translate(UPPER).decode()
    w = words(w)
    return {tuple(w[a:a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(sets, percent):
    """{id: least id of its component} by comparing all pairs of sets that share something."""
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for gram in s:
            having[gram].append(i)
    pairs = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: find(i) for i in sets}


def string_tiles(item, doc, least):
    """Greedy string tiling as published: all longest matches of each round, in order."""
    marked_i, marked_d = [False] * len(item), [False] * len(doc)
    found = []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                    and not marked_i[i + n] and not marked_d[d + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return found
        found.append(best)
        i, d, n = best
        marked_i[i:i + n] = [True] * n
        marked_d[d:d + n] = [True] * n


def non_overlapping(pattern, text, accept, flags=0):
    return [m.span() for m in re.finditer(pattern, text, flags) if accept(m)]
