"""Periodic runs of words by a harmonic grid (operator 12).

A run is a stretch of words that repeats with a smallest period, as far as it goes both ways. For every period p the words
at the places 0, p, 2p, ... of a text are compared with those p later: how far both go on alike forwards, and backwards.
Every run of at least two periods covers such a pair, so none is missed; the pairs of all periods are n log n.

How far two places go on alike is the least entry between them in the table of common prefixes of a suffix array (a range
minimum in blocks, linear in memory); backwards, that of the reversed words. Suffix arrays are built by prefix doubling
that sorts only what is not yet apart; common prefixes by extending those places that do not follow from the place before.

The operator is one Arrow-batched scan without a shuffle: texts are taken in batches of about ``batch_words`` words that
share one pair of suffix arrays, with a word of its own between any two texts. A text of any length is taken whole; all
tables are linear in its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 16
SLICE = 1 << 20
BLOCK = 16


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of non-negative numbers."""
    n = len(words)
    bits = int(words.max() + 1).bit_length()
    taken = min(max(1, 62 // bits), n)
    padded = np.concatenate([words.astype(np.int64) + 1, np.zeros(taken, dtype=np.int64)])
    key = padded[:n].copy()
    for k in range(1, taken):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    slots, ordered, step = np.arange(n), key[order], taken
    while True:
        new = np.empty(len(slots), dtype=bool)
        new[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        heads = np.maximum.accumulate(np.where(new, slots, -1))
        rank[order[slots]] = heads
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order, rank
        here = order[slots]
        beyond = here + step
        key = rank[here] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        moved = np.argsort(key, kind="stable")
        order[slots], ordered, step = here[moved], key[moved], 2 * step


def _extended(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For how many words the places ``a`` and ``b`` go on alike. The last word must occur once only."""
    length, active, width, last = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 4, len(words) - 1
    while len(active):
        going = []
        for at in range(0, len(active), max(1, SLICE // width)):
            some = active[at : at + max(1, SLICE // width)]
            across = length[some, None] + np.arange(width)
            alike = words[np.minimum(a[some, None] + across, last)] == words[np.minimum(b[some, None] + across, last)]
            whole = alike.all(axis=1)
            length[some] += np.where(whole, width, alike.argmin(axis=1))
            going.append(some[whole])
        active, width = np.concatenate(going), min(2 * width, 8192)
    return length


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Entry r: words that the suffixes of rank r - 1 and r have in common (0 for the first)."""
    n = len(words)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = words[place[follows] - 1] == words[before[follows] - 1]
    heads = np.flatnonzero(~follows)
    known = np.zeros(n, dtype=np.int64)
    met = heads[before[heads] >= 0]
    known[met] = _extended(words, met, before[met])
    head = np.maximum.accumulate(np.where(follows, 0, place))
    return np.maximum(known[head] - (place - head), 0)[order]


class RangeMinimum:
    """The least entry between two places, both included."""

    def __init__(self, entries: np.ndarray) -> None:
        self.most = np.iinfo(np.int32).max
        self.entries = np.full(-(-len(entries) // BLOCK) * BLOCK, self.most, dtype=np.int32)
        self.entries[: len(entries)] = entries
        rows = self.entries.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.onward = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
        levels = [rows.min(axis=1)]
        while 2 ** len(levels) <= len(levels[0]):
            last, half = levels[-1], 2 ** (len(levels) - 1)
            following = last.copy()
            following[:-half] = np.minimum(last[:-half], last[half:])
            levels.append(following)
        self.levels = np.stack(levels)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        between = np.flatnonzero(last - first > 1)
        begin, count = first[between] + 1, last[between] - first[between] - 1
        level = np.frexp(count)[1] - 1
        out[between] = np.minimum(out[between], np.minimum(self.levels[level, begin], self.levels[level, begin + count - (1 << level)]))
        within = np.flatnonzero(first == last)
        a, b = low[within], high[within]
        inside = np.full(len(within), self.most, dtype=np.int32)
        for k in range(BLOCK):
            at = np.minimum(a + k, b)
            np.minimum(inside, self.entries[at], out=inside)
        out[within] = inside
        return out


class Extensions:
    """Longest common extensions of places of one sequence whose last word occurs once only."""

    def __init__(self, words: np.ndarray) -> None:
        order, self.rank = suffix_order(words)
        self.minimum = RangeMinimum(common_prefixes(words, order))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For how many words the different places ``a`` and ``b`` go on alike."""
        x, y = self.rank[a], self.rank[b]
        return self.minimum.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _grid(starts: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every grid point that has another one a period later, in slices."""
    periods = sizes // times
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // period
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        count, p, begin = points[at:to], period[at:to], starts[text[at:to]]
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p = np.repeat(p, count)
        yield np.repeat(begin, count) + j * p, p
        at = to


def runs_of(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers (from 0), by start, then period: those of at least
    ``least`` words and ``times`` periods (two or more)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    able = [k for k, words in enumerate(texts) if len(words) >= max(least, times)]
    if not able:
        return found
    top = max(int(texts[k].max()) for k in able) + 1
    parts: list[np.ndarray] = [np.array([top])]
    for number, k in enumerate(able):
        parts += [texts[k], np.array([top + 1 + number])]
    words = np.concatenate(parts).astype(np.int64)
    sizes = np.array([len(texts[k]) for k in able])
    starts = np.cumsum(sizes + 1) - sizes
    n = len(words)
    forward, backward = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
    kept = []
    for place, period in _grid(starts, sizes, times):
        other = place + period
        alike = words[place] == words[other]  # elsewhere both extensions cannot make a run
        place, other, period = place[alike], other[alike], period[alike]
        if not len(place):
            continue
        on = forward.of(place, other)
        back = backward.of(n - place, n - other)
        length = period + on + back
        whole = length >= np.maximum(least, times * period)
        kept.append(np.stack([(place - back)[whole], length[whole], period[whole]], axis=1))
    rows = np.concatenate(kept) if kept else np.zeros((0, 3), dtype=np.int64)
    rows = np.unique(rows, axis=0)  # by start, length, period: of one stretch the smallest period comes first
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = np.searchsorted(starts, rows[:, 0], side="right") - 1
    for k, (start, length, period) in zip(of.tolist(), rows.tolist(), strict=True):
        found[able[k]].append((start - int(starts[k]), length, period))
    return found


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period (ties: smallest start, then period)."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie in no run, or only in first periods."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


#: A document's words, given its id and its words as they stand.
Rewriting = Callable[[str | None, list[bytes]], list[bytes]]


def repeated_by_id(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """Plants repetitions: of each document whose id's checksum ends in 0, the words from a place on repeat with a period;
    both follow from the checksum. A null id plants nothing."""
    n = len(words)
    checksum = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if checksum % 10 or not n:
        return words
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    give = numbers.setdefault
    return [np.fromiter((give(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)) for words in texts]


_RESULT = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _answered(ids: list[str | None], texts: list[list[bytes]], least: int, times: int) -> pd.DataFrame:
    rows = []
    for doc_id, words, runs in zip(ids, texts, runs_of(_numbered(texts), least, times), strict=True):
        best = highest(runs)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        rows.append((doc_id, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])
    return frame.astype(dict.fromkeys(("start", "length", "period", "exponent_milli"), "Int64"))


def _scan(frames: Iterator[pd.DataFrame], rewrite: Rewriting | None, least: int, times: int, batch_words: int) -> Iterator[pd.DataFrame]:
    ids: list[str | None] = []
    texts: list[list[bytes]] = []
    size = 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
            words = (text or "").encode().split()  # at what ASCII has as white space, no more
            texts.append(rewrite(doc_id, words) if rewrite else words)
            ids.append(doc_id)
            size += len(words) + 1
            if size >= batch_words:
                yield _answered(ids, texts, least, times)
                ids, texts, size = [], [], 0
    if ids:
        yield _answered(ids, texts, least, times)


def periodic_runs(docs: DataFrame, rewrite: Rewriting | None = None, least: int = 6, times: int = 4, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Runs among the words (``[^\\x20\\x09-\\x0D]+``) of each text of ``docs`` (doc_id, text).

    One row per row: doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest length / period
    (nulls where there is none), runs_sha256 (of all runs), collapsed_sha256 (of the text without the words that a run
    repeats). ``rewrite`` changes a text's words first. A null or empty text has no words and no runs; a null doc_id is
    kept; repeated rows are answered each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    scan = partial(_scan, rewrite=rewrite, least=least, times=times, batch_words=batch_words)
    return rows.mapInPandas(scan, _RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))
