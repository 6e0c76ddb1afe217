"""Periodic runs of words, by uniting suffixes in the order of falling LCP.

Suffixes of a text that stand next to each other in order are united by decreasing length of their common prefix. Each
class keeps its positions in order; when two classes unite at a common prefix of l words, positions that become neighbours
at a distance d <= l seed a run of period d: the words from the first one on repeat after d words for l words. Of a
run's seeds the one at its start is kept, whose length is d + l without any extension. The smallest period
of a run makes its start and the place a period later neighbours at just that l, so no run is missed.

A run of ``least`` words has a common prefix of at least half of that, so only suffixes whose first words occur
twice are sorted and united; the others would stay alone at every length that counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import wide

#: Positions that one piece of an ordered set holds at most.
PIECE = 1024


class Ordered:
    """An ordered set of positions in short pieces, so that one more moves few others."""

    __slots__ = ("pieces", "size")

    def __init__(self, x: int) -> None:
        self.pieces, self.size = [[x]], 1

    def __iter__(self) -> Iterator[int]:
        return (x for piece in self.pieces for x in piece)

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in; its neighbours on both sides."""
        pieces = self.pieces
        k = bisect_left(pieces, x, key=lambda p: p[-1]) if len(pieces) > 1 else 0
        k = min(k, len(pieces) - 1)
        piece = pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else pieces[k - 1][-1] if k else None
        after = piece[at] if at < len(piece) else pieces[k + 1][0] if k + 1 < len(pieces) else None
        piece.insert(at, x)
        if len(piece) > PIECE:
            pieces[k : k + 1] = [piece[: PIECE // 2], piece[PIECE // 2 :]]
        return before, after


def _repeated(words: np.ndarray, size: int) -> np.ndarray:
    """Places whose ``size`` words occur again, found by hashes: a few more may be among them."""
    n = len(words) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return np.sort(order[np.append(same, False) | np.insert(same, 0, False)])


def neighbours(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp): suffixes that share their first ``size`` words with another one, in order, and the common prefix with the one before.

    Ranks of 1, 2, 4 ... words by doubling; the common prefix of two suffixes is read off the ranks from the longest down.
    """
    places = _repeated(words, size)
    if not len(places):
        return places, places
    n, step = len(words), 1
    ranks = [words + 1]
    while ranks[-1].max() < n and step < n:
        second = np.zeros(n, np.int64)
        second[: n - step] = ranks[-1][step:]
        pairs = ranks[-1] * (n + 1) + second
        order = np.argsort(pairs, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = pairs[order[1:]] != pairs[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        step *= 2
    places = places[np.argsort(ranks[-1][places], kind="stable")]
    x, y, lcp = places[1:].copy(), places[:-1].copy(), np.zeros(len(places), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        inside = np.flatnonzero(np.maximum(x, y) < n)
        same = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
        x[same] += 1 << k
        y[same] += 1 << k
        lcp[same + 1] += 1 << k
    return places, lcp


def runs_of(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words or more, by start and period; ``words`` are numbers below their count, equal where words are."""
    size = max(1, (least + 1) // 2)
    places, lcp = neighbours(words, size)
    edges = np.flatnonzero(lcp >= size)
    if not len(edges):
        return []
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    used = np.unique(np.concatenate([edges, edges - 1]))
    sets: list[Ordered | None] = [None] * len(places)
    own, place = list(range(len(places))), places.tolist()
    for i in used.tolist():
        sets[i] = Ordered(place[i])
    text = words.tolist()
    found = []

    def root(i: int) -> int:
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    def seed(i: int | None, j: int | None, common: int) -> None:
        if i is not None and j is not None and j - i <= common and (i == 0 or text[i - 1] != text[j - 1]) and j - i + common >= least:
            found.append((i, j - i + common, j - i))

    for e, common in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = root(e - 1), root(e)
        if sets[a].size < sets[b].size:
            a, b = b, a
        larger, moved = sets[a], list(sets[b])
        own[b], sets[b] = a, None
        larger.size += len(moved)
        for k, x in enumerate(moved):
            before, after = larger.add(x)
            # next to another one of its own class a position has no new neighbour
            if k == 0 or before != moved[k - 1]:
                seed(before, x, common)
            if k + 1 == len(moved) or after is not None and after < moved[k + 1]:
                seed(x, after, common)
    return sorted(found, key=lambda r: (r[0], r[2]))


_KIND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def periodic(text: Column, least: int = 12) -> Column:
    """struct(n_words, runs, collapsed) of a text; see ``periodic_runs``."""

    def run(texts: pa.Array) -> pa.Array:
        counts, flat, sizes, kept = [], [], [], []
        for item in texts:
            words = (item.as_py() or "").encode().split()  # by the same six characters
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            runs = runs_of(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), least) if len(words) > len(numbers) else []
            if runs:
                inside = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    inside[start + period] += 1
                    inside[start + length] -= 1
                words = [w for w, drop in zip(words, np.cumsum(inside).tolist()) if not drop]
            counts.append(int(inside.size - 1) if runs else len(words))
            sizes.append(len(runs))
            flat += runs
            kept.append(b" ".join(words).decode())
        columns = np.array(flat, np.int64).reshape(-1, 3).T
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), values)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(kept, pa.string())], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, _KIND)(text)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12, into: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, runs (start, length, period), collapsed.

    Words are what white space (six ASCII characters) parts, as they are written. A run is a stretch of words with smallest
    period q and at least max(``least``, 2 q) words that no neighbouring word extends with that period; start
    and length count words. collapsed holds the words, joined by one space, that no run repeats after its first period.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Ids are not read, and repeated rows
    keep a row each. A column named as ``into`` is replaced; others stay. Empty table: no rows. A text is read by
    one task; its time grows with its length and with the repeats in it, not with their square.
    """
    return wide(docs).withColumn(into, periodic(F.col(text_col).cast("string"), least))
